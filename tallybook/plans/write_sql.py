"""SQL of the queries for sources, sinks, bulk changes and order intake.

Stock allocation depends on every earlier decision; its SQL walks the sales one by one in a
recursive expression that carries the list of all stocks along.
"""

from __future__ import annotations

from tallybook.plans.parameters import PROCESSING_YEAR, STOCK_FACTOR
from tallybook.plans.report_sql import folded
from tallybook.sources.bindings import with_tables

_LOADED = {
    "customers": "bo_customers",
    "products": "bo_products",
    "orders": "bo_orders",
    "order_items": "bo_order_items",
    "task_categories": "bo_task_categories",
    "tasks": "bo_tasks",
    "recipes": "bo_recipes",
    "recipe_log": "bo_recipe_log",
    "recipe_ingredients": "bo_recipe_ingredients",
    "oil_disposals": "bo_oil_disposals",
    "financial_transactions": "bo_ledger",
}

_NEW_TASKS = """
, new_tasks AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS title,
    CASE WHEN event_type <> 'view' THEN props END AS description, ts AS due_date,
    CASE WHEN user_id % 9 = 0 THEN 'urgent' ELSE 'low' END AS priority, 'pending' AS status,
    NULLIF(user_id % 6, 0) AS category_id, NULLIF(CAST(event_id % 4 * 15 AS INT), 0) AS reminder_minutes
  FROM events),
checked AS (SELECT *, CASE WHEN title = '' THEN 'missing:title' WHEN priority = 'urgent' THEN 'invalid:priority'
    WHEN category_id NOT IN (SELECT id FROM bo_task_categories) THEN 'unknown:category_id' END AS reject_reason
  FROM new_tasks)"""

_TASKS_AFTER = (
    _NEW_TASKS
    + """
SELECT * FROM bo_tasks
UNION ALL
SELECT (SELECT MAX(id) FROM bo_tasks) + row_number() OVER (ORDER BY seq), title, description, due_date, priority,
  status, category_id, reminder_minutes FROM checked WHERE reject_reason IS NULL"""
)

_PRODUCTS_AFTER = """
, latest AS (SELECT user_id AS id, max_by(CAST(floor(value) AS INT), event_id) AS current_stock,
    max_by(event_type, event_id) AS unit
  FROM events WHERE event_type <> 'error' GROUP BY user_id)
SELECT p.* REPLACE (CASE WHEN l.id IS NULL THEN p.current_stock ELSE l.current_stock END AS current_stock,
  CASE WHEN l.id IS NULL THEN p.unit ELSE l.unit END AS unit)
FROM bo_products p LEFT JOIN latest l ON l.id = p.id"""

_PRICE = "COALESCE(NULLIF(unit_price, 0), valor, unit_price)"


def _recipe_feed(recipe: str, unknown: str) -> str:
    """``heads`` with a reason, and ``lines`` of the recipes written; ``recipe`` is the id they name."""
    return f"""
, lines AS (SELECT l_orderkey AS feed_id, l_linenumber AS line_no,
    CASE WHEN l_linenumber = 7 AND l_partkey % 4 = 0 THEN -l_partkey ELSE l_partkey END AS product_id,
    CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
    CASE WHEN l_linenumber <> 6 OR l_returnflag <> 'A' THEN 'un' END AS unit, l_returnflag AS notes FROM lineitem),
judged AS (SELECT *, CASE WHEN unit IS NULL THEN 'missing:unit'
    WHEN product_id NOT IN (SELECT id FROM bo_products) THEN 'unknown:product_id' END AS fault FROM lines),
faults AS (SELECT feed_id, min_by(fault, line_no) AS fault FROM judged WHERE fault IS NOT NULL GROUP BY feed_id),
feed AS (SELECT o_orderkey AS feed_id, {recipe} AS id,
    CASE WHEN o_orderstatus <> 'P' THEN CONCAT('Receita ', o_orderkey) END AS name, o_orderpriority AS category,
    CAST(o_orderkey % 90 AS INT) AS prep_time, CAST(NULL AS VARCHAR) AS image_url, o_orderstatus AS instructions,
    CAST(NULL AS VARCHAR) AS notes FROM orders),
heads AS (SELECT f.*, CASE WHEN {unknown} THEN 'unknown:recipe' WHEN f.name IS NULL THEN 'missing:name'
    ELSE x.fault END AS reject_reason FROM feed f LEFT JOIN faults x ON x.feed_id = f.feed_id)"""


_NEW_RECIPES = (
    _recipe_feed("CAST(NULL AS BIGINT)", "false")
    + """
, taken AS (SELECT * REPLACE ((SELECT MAX(id) FROM bo_recipes) + row_number() OVER (ORDER BY feed_id) AS id)
  FROM heads WHERE reject_reason IS NULL)"""
)
_REVISED_RECIPES = (
    _recipe_feed(
        "CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END",
        "f.id NOT IN (SELECT id FROM bo_recipes)",
    )
    + """
, taken AS (SELECT * FROM heads WHERE reject_reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY feed_id DESC) = 1)"""
)
_RECIPE_ROWS = "id, name, category, prep_time, image_url, instructions, notes"
_INGREDIENT_ROWS = "id, recipe_id, product_id, CAST(quantity AS DOUBLE) AS quantity, unit, notes"
_INGREDIENTS_ADDED = f"""
SELECT {_INGREDIENT_ROWS} FROM (SELECT (SELECT MAX(id) FROM bo_recipe_ingredients) + row_number() OVER
  (ORDER BY t.id, l.line_no, l.product_id, l.quantity, l.unit, l.notes) AS id, t.id AS recipe_id,
  l.product_id, l.quantity, l.unit, l.notes FROM taken t JOIN lines l ON l.feed_id = t.feed_id)"""
_RECIPE_TABLES = ("bo_products", "bo_recipes", "bo_recipe_ingredients")


def _customers(feed: str) -> str:
    return f"""
, feed AS (SELECT feed_id, arrival_seq, customer, {folded('rtrim(customer)')} AS k FROM {feed}),
known AS (SELECT {folded('rtrim(name)')} AS k, MIN(id) AS customer_id FROM bo_customers GROUP BY 1),
firsts AS (SELECT k, MIN(arrival_seq) AS a, min_by(customer, arrival_seq) AS customer FROM feed
  WHERE k NOT IN (SELECT k FROM known) GROUP BY k),
created AS (SELECT k, customer AS name, (SELECT MAX(id) FROM bo_customers) + row_number() OVER (ORDER BY a) AS id
  FROM firsts)"""


_CUSTOMERS = _customers("bo_orders_feed")


def _numbers(feed: str) -> str:
    return f"""
, f AS (SELECT feed_id, arrival_seq, CASE lower(channel) WHEN 'whatsapp' THEN 'WAT' WHEN 'ifood' THEN 'IFO'
    ELSE 'BAL' END AS prefix FROM {feed}),
m AS (SELECT split_part(order_number, '-', 1) AS prefix, MAX(CAST(split_part(order_number, '-', 3) AS BIGINT)) AS s
  FROM bo_orders WHERE split_part(order_number, '-', 2) = '{PROCESSING_YEAR}' GROUP BY 1),
numbers AS (SELECT f.feed_id, CONCAT(f.prefix, '-{PROCESSING_YEAR}-', printf('%04d', COALESCE(m.s, 0)
  + row_number() OVER (PARTITION BY f.prefix ORDER BY f.arrival_seq))) AS order_number
FROM f LEFT JOIN m ON m.prefix = f.prefix)"""


def _judged(sold: str) -> str:
    return f"""
, sold AS (SELECT id FROM bo_products WHERE {sold}),
wrong AS (SELECT feed_id, line_no, CASE WHEN product_id = 0 OR quantity <= 0 THEN 'incomplete_item'
    WHEN product_id NOT IN (SELECT id FROM sold) THEN 'unknown_product' END AS reason FROM bo_items_feed),
faults AS (SELECT feed_id, MIN(CAST(line_no AS VARCHAR) || reason) AS reason FROM wrong
  WHERE reason IS NOT NULL GROUP BY feed_id),
checked AS (SELECT f.feed_id, CASE WHEN f.feed_id NOT IN (SELECT feed_id FROM bo_items_feed) THEN 'no_items'
    WHEN f.status IS NULL THEN 'no_status' ELSE substr(w.reason, 2) END AS reject_reason
FROM bo_orders_feed f LEFT JOIN faults w ON w.feed_id = f.feed_id)"""


def _walked(sales: str) -> str:
    """``queue`` numbers the sales, ``walk`` says which were taken, ``turns`` what each line found.

    Lines of one product wait for each other; a sale has its turn when all its lines are the next
    of their product. A step of the recursion serves all sales that have theirs.
    """
    return f"""
, stock AS (SELECT id, name, CAST(current_stock AS BIGINT) * {STOCK_FACTOR} AS s FROM bo_products),
queue AS (SELECT feed_id, row_number() OVER (ORDER BY arrival_seq, feed_id) AS seq FROM bo_orders_feed WHERE {sales}),
wanted AS (SELECT feed_id, product_id, CAST(SUM(quantity) AS BIGINT) AS d, CAST(MAX(quantity) AS BIGINT) AS n
  FROM bo_items_feed GROUP BY feed_id, product_id),
waiting AS (SELECT q.seq, w.product_id, w.d, w.n, row_number() OVER (PARTITION BY w.product_id ORDER BY q.seq) AS place,
    count(*) OVER (PARTITION BY q.seq) AS width
  FROM queue q JOIN wanted w ON w.feed_id = q.feed_id JOIN stock k ON k.id = w.product_id),
turns(product_id, place, st, seq, available, ok) AS (
  SELECT id, CAST(1 AS BIGINT), s, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM stock
  UNION ALL
  SELECT product_id, place + CASE WHEN ready THEN 1 ELSE 0 END, st - CASE WHEN ready AND fits THEN d ELSE 0 END,
    CASE WHEN ready THEN seq END, st, fits
  FROM (SELECT w.product_id, w.place, t.st, w.seq, w.d, count(*) OVER (PARTITION BY w.seq) = w.width AS ready,
      bool_and(t.st >= w.n) OVER (PARTITION BY w.seq) AS fits
    FROM turns t JOIN waiting w ON w.product_id = t.product_id AND w.place = t.place)),
walk AS (SELECT q.seq, COALESCE(bool_and(t.ok), true) AS ok FROM queue q LEFT JOIN turns t ON t.seq = q.seq GROUP BY q.seq)"""


def _recursive(body: str, *names: str) -> str:
    return with_tables(body, *names).replace("WITH ", "WITH RECURSIVE ", 1)


_TAKEN_IN = (
    _judged("true")
    + _walked("feed_id IN (SELECT feed_id FROM checked WHERE reject_reason IS NULL)")
    + """
, taken AS (SELECT o.* FROM bo_orders_feed o JOIN queue q ON q.feed_id = o.feed_id JOIN walk w ON w.seq = q.seq AND w.ok),
refused AS (SELECT feed_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL
  UNION ALL SELECT q.feed_id, 'out_of_stock' FROM queue q JOIN walk w ON w.seq = q.seq AND NOT w.ok)"""
    + _numbers("taken")
)

_INTAKE_TABLES = ("bo_products", "bo_customers", "bo_orders", "bo_order_items", "bo_ledger", "bo_orders_feed", "bo_items_feed")


def _stacked(table: str, key: str, other: str, amount: str, texts: list[str], source: str) -> str:
    detail = " || '|' || ".join(f"COALESCE(CAST({t} AS VARCHAR), '')" for t in texts)
    return f"""SELECT '{table}' AS table_name, CAST({key} AS BIGINT) AS key, CAST({other} AS BIGINT) AS other_key,
  CAST({amount} AS DOUBLE) AS amount, {detail} AS detail FROM {source}"""


_ORDER_TEXTS = ["order_number", "channel", "status", "day", "payment_method"]
_ENTRY_TEXTS = ["description", "type", "category", "transaction_date"]

_TABLES_AFTER = (
    _TAKEN_IN
    + _customers("taken")
    + f"""
, totals AS (SELECT feed_id, SUM(quantity * {_PRICE}) AS total_amount FROM bo_items_feed GROUP BY feed_id),
booked AS (SELECT t.feed_id, row_number() OVER (ORDER BY t.arrival_seq, t.feed_id) AS n, u.order_number,
    COALESCE(k.customer_id, c.id) AS customer_id, s.total_amount, t.status, t.channel AS said, lower(t.channel) AS channel,
    CAST(t.order_date AS TIMESTAMP) AS order_date, CAST(CAST(t.order_date AS TIMESTAMP) AS DATE) AS day, t.payment_method
  FROM taken t JOIN numbers u ON u.feed_id = t.feed_id JOIN feed d ON d.feed_id = t.feed_id
  JOIN totals s ON s.feed_id = t.feed_id LEFT JOIN known k ON k.k = d.k LEFT JOIN created c ON c.k = d.k),
old_orders AS (SELECT *, CAST(order_date AS DATE) AS day FROM bo_orders),
new_orders AS (SELECT (SELECT MAX(id) FROM bo_orders) + n AS id, * FROM booked),
new_items AS (SELECT o.id AS order_id, i.line_no AS line_number, i.product_id, i.quantity, {_PRICE} AS unit_price
  FROM new_orders o JOIN bo_items_feed i ON i.feed_id = o.feed_id),
new_entries AS (SELECT (SELECT MAX(id) FROM bo_ledger) + n AS id,
    CONCAT('Venda ', order_number, ' (', said, ')') AS description, total_amount AS amount, 'entrada' AS type,
    'venda' AS category, day AS transaction_date FROM new_orders),
after_sales AS (SELECT p.id, p.name, p.current_stock * {STOCK_FACTOR} - COALESCE(s.q, 0) AS stock FROM bo_products p
  LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM new_items GROUP BY product_id) s ON s.product_id = p.id)
"""
    + "\nUNION ALL\n".join(
        [
            _stacked("decisions", "feed_id", "NULL", "NULL", ["order_number", "NULL"], "numbers"),
            _stacked("decisions", "feed_id", "NULL", "NULL", ["NULL", "reject_reason"], "refused"),
            *[_stacked("customers", "id", "NULL", "NULL", ["name"], t) for t in ("bo_customers", "created")],
            _stacked("products", "id", "NULL", "stock", ["name"], "after_sales"),
            *[
                _stacked("orders", "id", "customer_id", "total_amount", _ORDER_TEXTS, t)
                for t in ("old_orders", "new_orders")
            ],
            *[
                _stacked("order_items", "order_id", "product_id", "unit_price", ["line_number", "quantity"], t)
                for t in ("bo_order_items", "new_items")
            ],
            *[
                _stacked("financial_transactions", "id", "NULL", "amount", _ENTRY_TEXTS, t)
                for t in ("bo_ledger", "new_entries")
            ],
        ]
    )
)

_REVISION = f"""
, ch AS (SELECT o_orderkey AS change_id, o_custkey AS id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'archived' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS observations,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CONCAT('Cliente novo ', CAST(o_custkey AS VARCHAR)) END AS customer,
    CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS order_date,
    CASE WHEN o_orderstatus = 'F' THEN 'dinheiro' ELSE 'pix' END AS payment_method,
    o_totalprice AS amount_received
  FROM orders),
il AS (SELECT feed_id AS change_id, line_no, product_id, quantity,
    COALESCE(unit_price, CASE WHEN line_no <> 1 THEN valor END) AS unit_price FROM bo_items_feed),
bad AS (SELECT DISTINCT change_id FROM il WHERE product_id = 0 OR unit_price IS NULL),
sums AS (SELECT change_id, SUM(quantity * unit_price) AS total FROM il GROUP BY change_id),
judged AS (SELECT ch.*, COALESCE(s.total, 0) AS total, CASE WHEN status IS NULL THEN 'no_status'
    WHEN ch.change_id IN (SELECT change_id FROM bad) THEN 'invalid_item'
    WHEN ch.id NOT IN (SELECT id FROM bo_orders) THEN 'unknown_order' END AS reject_reason
  FROM ch LEFT JOIN sums s ON s.change_id = ch.change_id),
ok AS (SELECT * FROM judged WHERE reject_reason IS NULL),
known AS (SELECT {folded('rtrim(name)')} AS k, MIN(id) AS customer_id FROM bo_customers GROUP BY 1),
firsts AS (SELECT {folded('rtrim(customer)')} AS k, MIN(change_id) AS a FROM ok WHERE customer IS NOT NULL GROUP BY 1),
names AS (SELECT * FROM known UNION ALL
  SELECT k, (SELECT MAX(id) FROM bo_customers) + row_number() OVER (ORDER BY a) FROM firsts
  WHERE k NOT IN (SELECT k FROM known)),
last AS (SELECT id, MAX(change_id) AS change_id, max_by(status, change_id) AS status,
    arg_max_null(observations, change_id) AS observations, max_by(total, change_id) AS total,
    max_by(payment_method, change_id) AS payment_method, max_by(amount_received, change_id) AS amount_received,
    max_by(order_date, CASE WHEN order_date IS NOT NULL THEN change_id END) AS order_date,
    max_by(customer, CASE WHEN customer IS NOT NULL THEN change_id END) AS customer
  FROM ok GROUP BY id),
revised AS (SELECT l.*, n.customer_id FROM last l LEFT JOIN names n ON n.k = {folded('rtrim(l.customer)')})"""

_REVISED_TABLES = ("bo_orders", "bo_items_feed", "bo_customers")

SQL: dict[str, str] = {
    "load_tables": with_tables(
        "\nUNION ALL\n".join(
            f"SELECT '{name}' AS table_name, COUNT(*) AS rows, CAST(0 AS BIGINT) AS violations FROM {bound}"
            for name, bound in _LOADED.items()
        ),
        *_LOADED.values(),
    ),
    "append_rows": with_tables(_TASKS_AFTER, "bo_tasks", "bo_task_categories"),
    "write_snapshot": with_tables(_PRODUCTS_AFTER, "bo_products"),
    "to_json_documents": with_tables(
        """
SELECT CAST(to_json({'id': id, 'name': name, 'category': category, 'description': description,
  'current_stock': current_stock, 'minimum_stock': minimum_stock, 'unit': unit}) AS VARCHAR) AS json
FROM bo_products""",
        "bo_products",
    ),
    "insert_rows": with_tables(_TASKS_AFTER, "bo_tasks", "bo_task_categories"),
    "insert_rows_rejected": with_tables(
        _NEW_TASKS + " SELECT seq, reject_reason FROM checked WHERE reject_reason IS NOT NULL",
        "bo_task_categories",
    ),
    "update_rows": with_tables(_PRODUCTS_AFTER, "bo_products"),
    "delete_rows": with_tables(
        """
, c AS (SELECT id FROM bo_customers
  WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')),
o AS (SELECT id FROM bo_orders WHERE customer_id IN (SELECT id FROM c))
SELECT 'customers' AS table_name, id AS key FROM c
UNION ALL SELECT 'orders', id FROM o
UNION ALL SELECT 'order_items', order_id FROM bo_order_items WHERE order_id IN (SELECT id FROM o)""",
        "bo_customers",
        "bo_orders",
        "bo_order_items",
    ),
    "delete_products": with_tables(
        """
, p AS (SELECT id FROM bo_products WHERE category <> 'PROMO')
SELECT 'products' AS table_name, id AS key FROM p
UNION ALL SELECT 'order_items', order_id FROM bo_order_items WHERE product_id IN (SELECT id FROM p)
UNION ALL SELECT 'recipe_ingredients', id FROM bo_recipe_ingredients WHERE product_id IN (SELECT id FROM p)""",
        "bo_products",
        "bo_order_items",
        "bo_recipe_ingredients",
    ),
    "insert_ledger_rows": with_tables(
        """
SELECT id, description, CAST(amount AS DOUBLE) AS amount, type, category, transaction_date FROM bo_ledger
UNION ALL
SELECT (SELECT MAX(id) FROM bo_ledger) + row_number() OVER (ORDER BY c_custkey), c_name, abs(c_acctbal),
  CASE WHEN c_acctbal < 0 THEN 'saida' ELSE 'entrada' END, 'outros', DATE '1998-01-01'
FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
        "bo_ledger",
    ),
    "mark_reminders_sent": with_tables(
        """
SELECT t.id, t.title, e.event_type = 'error' AS reminder_sent
FROM bo_tasks t JOIN events e ON e.event_id = t.id""",
        "bo_tasks",
    ),
    "delete_set_null": with_tables(
        """
SELECT t.* REPLACE (CASE WHEN category_id NOT IN
  (SELECT id FROM bo_task_categories WHERE name IN ('ASIA', 'EUROPE')) THEN category_id END AS category_id)
FROM bo_tasks t""",
        "bo_tasks",
        "bo_task_categories",
    ),
    "insert_recipes": with_tables(
        f"{_NEW_RECIPES} SELECT {_RECIPE_ROWS} FROM bo_recipes UNION ALL SELECT {_RECIPE_ROWS} FROM taken",
        *_RECIPE_TABLES,
    ),
    "insert_recipe_ingredients": with_tables(
        f"{_NEW_RECIPES} SELECT {_INGREDIENT_ROWS} FROM bo_recipe_ingredients UNION ALL {_INGREDIENTS_ADDED}",
        *_RECIPE_TABLES,
    ),
    "insert_recipes_rejected": with_tables(
        f"{_NEW_RECIPES} SELECT feed_id, reject_reason FROM heads WHERE reject_reason IS NOT NULL", *_RECIPE_TABLES
    ),
    "revise_recipes": with_tables(
        f"""{_REVISED_RECIPES}
SELECT {_RECIPE_ROWS} FROM bo_recipes WHERE id NOT IN (SELECT id FROM taken)
UNION ALL SELECT {_RECIPE_ROWS} FROM taken""",
        *_RECIPE_TABLES,
    ),
    "revise_recipe_ingredients": with_tables(
        f"""{_REVISED_RECIPES}
SELECT {_INGREDIENT_ROWS} FROM bo_recipe_ingredients WHERE recipe_id NOT IN (SELECT id FROM taken)
UNION ALL {_INGREDIENTS_ADDED}""",
        *_RECIPE_TABLES,
    ),
    "revise_recipes_rejected": with_tables(
        f"{_REVISED_RECIPES} SELECT feed_id, reject_reason FROM heads WHERE reject_reason IS NOT NULL",
        *_RECIPE_TABLES,
    ),
    "replace_children": with_tables(
        """
, p AS (SELECT id FROM bo_orders WHERE status = 'pending')
SELECT order_id, line_number, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price
FROM bo_order_items WHERE order_id NOT IN (SELECT id FROM p)
UNION ALL
SELECT order_id, MIN(line_number), product_id, CAST(SUM(quantity) AS INT), CAST(MAX(unit_price) AS DOUBLE)
FROM bo_order_items WHERE order_id IN (SELECT id FROM p) GROUP BY order_id, product_id""",
        "bo_orders",
        "bo_order_items",
    ),
    "intake_validate": with_tables(
        _judged("category <> 'PROMO'") + " SELECT feed_id, reject_reason FROM checked",
        "bo_products",
        "bo_orders_feed",
        "bo_items_feed",
    ),
    "intake_allocate_stock": _recursive(
        _walked("true") + " SELECT q.feed_id, w.ok AS accepted FROM queue q JOIN walk w ON w.seq = q.seq",
        "bo_products",
        "bo_orders_feed",
        "bo_items_feed",
    ),
    "intake_shortages": _recursive(
        _walked("true")
        + """
SELECT i.feed_id, i.product_id, k.name AS product, t.available, i.quantity AS requested
FROM turns t JOIN queue q ON q.seq = t.seq
JOIN bo_items_feed i ON i.feed_id = q.feed_id AND i.product_id = t.product_id JOIN stock k ON k.id = i.product_id
WHERE NOT t.ok AND i.quantity > t.available""",
        "bo_products",
        "bo_orders_feed",
        "bo_items_feed",
    ),
    "order_intake": _recursive(
        _TAKEN_IN
        + _customers("taken")
        + f"""
, totals AS (SELECT feed_id, CAST(SUM(quantity * {_PRICE}) AS DOUBLE) AS total_amount FROM bo_items_feed GROUP BY feed_id)
SELECT t.feed_id, t.order_number, COALESCE(n.customer_id, c.id) AS customer_id, s.total_amount,
  CAST(NULL AS VARCHAR) AS reject_reason
FROM numbers t JOIN feed d ON d.feed_id = t.feed_id JOIN totals s ON s.feed_id = t.feed_id
LEFT JOIN known n ON n.k = d.k LEFT JOIN created c ON c.k = d.k
UNION ALL SELECT feed_id, NULL, NULL, NULL, reject_reason FROM refused""",
        "bo_products",
        "bo_customers",
        "bo_orders",
        "bo_orders_feed",
        "bo_items_feed",
    ),
    "order_intake_tables": _recursive(_TABLES_AFTER, *_INTAKE_TABLES),
    "intake_order_numbers": with_tables(
        _numbers("bo_orders_feed") + " SELECT feed_id, order_number FROM numbers",
        "bo_orders_feed",
        "bo_orders",
    ),
    "order_number_max": with_tables(
        """
SELECT split_part(order_number, '-', 1) AS prefix, CAST(split_part(order_number, '-', 2) AS INT) AS year,
  MAX(CAST(split_part(order_number, '-', 3) AS BIGINT)) AS last_seq FROM bo_orders GROUP BY 1, 2""",
        "bo_orders",
    ),
    "intake_resolve_customers": with_tables(
        _CUSTOMERS
        + """
SELECT f.feed_id, COALESCE(n.customer_id, c.id) AS customer_id
FROM feed f LEFT JOIN known n ON n.k = f.k LEFT JOIN created c ON c.k = f.k""",
        "bo_orders_feed",
        "bo_customers",
    ),
    "intake_new_customers": with_tables(
        _CUSTOMERS + " SELECT id, name FROM created", "bo_orders_feed", "bo_customers"
    ),
    "order_totals": with_tables(
        f"""
SELECT feed_id AS order_id, CAST(SUM(quantity * {_PRICE}) AS DOUBLE) AS total_amount
FROM bo_items_feed GROUP BY feed_id""",
        "bo_items_feed",
    ),
    "intake_payment_fields": with_tables(
        """
SELECT feed_id, whatsapp AS whatsapp_number, ifood AS ifood_order, NULLIF(attendant, '') AS attendant,
  payment_method, CASE WHEN payment_method = 'dinheiro' THEN amount_received END AS amount_received,
  CASE WHEN payment_method = 'dinheiro' THEN change_given END AS change_given FROM bo_orders_feed""",
        "bo_orders_feed",
    ),
    "ledger_from_orders": with_tables(
        """
SELECT CONCAT('Venda ', order_number, ' (', channel, ')') AS description, CAST(total_amount AS DOUBLE) AS amount,
  'entrada' AS type, 'venda' AS category, CAST(order_date AS DATE) AS transaction_date FROM bo_orders""",
        "bo_orders",
    ),
    "stock_after_orders": with_tables(
        """
SELECT p.* REPLACE (CAST(p.current_stock - COALESCE(s.q, 0) AS INT) AS current_stock) FROM bo_products p
LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM bo_order_items GROUP BY product_id) s ON s.product_id = p.id""",
        "bo_products",
        "bo_order_items",
    ),
    "revise_orders": with_tables(
        _REVISION
        + """
SELECT o.id, o.order_number, COALESCE(r.customer_id, o.customer_id) AS customer_id,
  CAST(CASE WHEN r.id IS NULL THEN o.total_amount ELSE r.total END AS DOUBLE) AS total_amount,
  CASE WHEN r.id IS NULL THEN o.status WHEN r.status = 'delivered' THEN 'delivered' ELSE 'pending' END AS status,
  CASE WHEN r.id IS NULL THEN o.observations ELSE COALESCE(r.observations, '') END AS observations,
  COALESCE(r.order_date, o.order_date) AS order_date, COALESCE(r.payment_method, o.payment_method) AS payment_method,
  CAST(CASE WHEN r.payment_method = 'dinheiro' THEN r.amount_received END AS DOUBLE) AS amount_received,
  CAST(CASE WHEN r.payment_method = 'dinheiro' THEN 0.5 END AS DOUBLE) AS change_given
FROM bo_orders o LEFT JOIN revised r ON r.id = o.id""",
        *_REVISED_TABLES,
    ),
    "revise_orders_items": with_tables(
        _REVISION
        + """
SELECT order_id, line_number, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price FROM bo_order_items
WHERE order_id NOT IN (SELECT id FROM revised)
UNION ALL
SELECT r.id, i.line_no, i.product_id, i.quantity, CAST(i.unit_price AS DOUBLE)
FROM revised r JOIN il i ON i.change_id = r.change_id""",
        *_REVISED_TABLES,
        "bo_order_items",
    ),
    "revise_orders_ledger": with_tables(
        _REVISION
        + """
, nums AS (SELECT o.order_number, r.total, CAST(COALESCE(r.order_date, o.order_date) AS DATE) AS d
  FROM revised r JOIN bo_orders o ON o.id = r.id)
SELECT l.id, l.description, CAST(COALESCE(n.total, l.amount) AS DOUBLE) AS amount, l.type, l.category,
  COALESCE(n.d, l.transaction_date) AS transaction_date
FROM bo_ledger l LEFT JOIN nums n ON l.type = 'entrada' AND l.category = 'venda'
  AND n.order_number = split_part(l.description, ' ', 2)""",
        *_REVISED_TABLES,
        "bo_ledger",
    ),
    "revise_orders_rejected": with_tables(
        _REVISION + " SELECT change_id, id, reject_reason FROM judged WHERE reject_reason IS NOT NULL",
        *_REVISED_TABLES,
    ),
    "void_orders": with_tables(
        """
, v AS (SELECT id, order_number FROM bo_orders WHERE status = 'pending')
SELECT 'orders' AS table_name, id AS key FROM bo_orders WHERE id NOT IN (SELECT id FROM v)
UNION ALL SELECT 'order_items', order_id FROM bo_order_items WHERE order_id NOT IN (SELECT id FROM v)
UNION ALL SELECT 'financial_transactions', id FROM bo_ledger WHERE NOT (description LIKE 'Venda %'
  AND split_part(description, ' ', 2) IN (SELECT order_number FROM v))""",
        "bo_orders",
        "bo_order_items",
        "bo_ledger",
    ),
}

STREAM_SQL: dict[str, str] = {
    "stream_recipe_log": with_tables("SELECT * FROM bo_recipe_log", "bo_recipe_log"),
    "stream_recipe_counts": with_tables(
        "SELECT recipe_id, action, COUNT(*) AS times FROM bo_recipe_log GROUP BY recipe_id, action",
        "bo_recipe_log",
    ),
    "stream_daily_sales": with_tables(
        """
SELECT CAST(order_date AS DATE) AS day, CAST(SUM(total_amount) AS DOUBLE) AS total, COUNT(*) AS orders
FROM bo_orders GROUP BY 1""",
        "bo_orders",
    ),
    "stream_recipe_log_replayed": with_tables("SELECT * FROM bo_recipe_log", "bo_recipe_log"),
    "stream_recipe_counts_replayed": with_tables(
        "SELECT recipe_id, action, COUNT(*) AS times FROM bo_recipe_log GROUP BY recipe_id, action",
        "bo_recipe_log",
    ),
    "stream_daily_sales_late": with_tables(
        """
, sent AS (SELECT order_date, total_amount,
    GREATEST(LEAST(YEAR(order_date) + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END, 2001), 1995) AS file FROM bo_orders),
newest AS (SELECT file, MAX(MAX(order_date)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at
  FROM sent GROUP BY file)
SELECT CASE WHEN date_trunc('day', s.order_date) + INTERVAL 1 DAY <= n.at - INTERVAL 1 DAY THEN 'late' ELSE 'taken' END AS kind,
  CAST(s.order_date AS DATE) AS day, CAST(SUM(s.total_amount) AS DOUBLE) AS total, COUNT(*) AS orders
FROM sent s JOIN newest n ON n.file = s.file GROUP BY 1, 2""",
        "bo_orders",
    ),
    "stream_order_intake_batches": _recursive(_TABLES_AFTER, *_INTAKE_TABLES),
    "stream_order_intake": _recursive(
        _TAKEN_IN
        + """
SELECT feed_id, order_number, CAST(NULL AS VARCHAR) AS reject_reason FROM numbers
UNION ALL SELECT feed_id, NULL, reject_reason FROM refused""",
        "bo_products",
        "bo_orders",
        "bo_orders_feed",
        "bo_items_feed",
    ),
}
