"""SQL of the report and search queries."""

from __future__ import annotations

from tallybook.functions.text import ACCENTED, PLAIN
from tallybook.plans.parameters import (
    HALF_YEAR,
    LOG_AS_OF,
    MONTH,
    ORDERS_AS_OF,
    ORDERS_SEEN,
    TASKS_AS_OF,
    TASKS_FROM,
    TASKS_TO,
)
from tallybook.sources.bindings import with_tables

DAY = f"CAST(TIMESTAMP '{ORDERS_AS_OF}' AS DATE)"


def folded(column: str) -> str:
    return f"translate(lower({column}), '{ACCENTED}', '{PLAIN}')"


def _holds(needle: str, *columns: str) -> str:
    return "(" + " OR ".join(f"COALESCE(contains({folded(c)}, '{needle}'), FALSE)" for c in columns) + ")"


_LOW_RING = f"current_stock < minimum_stock AND current_stock > 0 AND {_holds('ring', 'name', 'description')}"
_LABEL = """CASE WHEN current_stock = 0 THEN 'out' WHEN current_stock < minimum_stock THEN 'low'
  ELSE 'normal' END AS stock_status"""
_RECIPE_1 = _holds("1", "name", "instructions", "notes")
_OVERDUE_ERROR = (
    f"due_date < TIMESTAMP '{TASKS_AS_OF}' AND status <> 'completed' AND "
    + _holds("error", "title", "description")
)
_IN_HALF = f"BETWEEN DATE '{HALF_YEAR[0]}' AND DATE '{HALF_YEAR[1]}'"
_INCOME = "COALESCE(SUM(CASE WHEN type = 'entrada' THEN amount END), 0)"
_EXPENSE = "COALESCE(SUM(CASE WHEN type = 'saida' THEN amount END), 0)"

SQL: dict[str, str] = {
    "sales_kpis": with_tables(
        f"""
, s AS (SELECT
  CAST(COALESCE(SUM(CASE WHEN CAST(order_date AS DATE) = {DAY} THEN total_amount END), 0) AS DOUBLE) AS t,
  CAST(COALESCE(SUM(CASE WHEN CAST(order_date AS DATE) = {DAY} - 1 THEN total_amount END), 0) AS DOUBLE) AS y,
  COUNT(CASE WHEN CAST(order_date AS DATE) = {DAY} THEN 1 END) AS ot,
  COUNT(CASE WHEN CAST(order_date AS DATE) = {DAY} - 1 THEN 1 END) AS oy FROM bo_orders)
SELECT t AS today_sales, CASE WHEN y > 0 THEN ROUND((t - y) / y * 100, 1) ELSE 0.0::DOUBLE END AS sales_change,
  ot AS today_orders,
  CASE WHEN oy > 0 THEN ROUND((ot - oy)::DOUBLE / oy * 100, 1) ELSE 0.0::DOUBLE END AS orders_change,
  (SELECT COUNT(*) FROM bo_products WHERE current_stock < minimum_stock) AS low_stock_count,
  (SELECT COUNT(*) FROM bo_customers WHERE MONTH(created_at) = MONTH({DAY})
    AND YEAR(created_at) = YEAR({DAY})) AS new_customers
FROM s""",
        "bo_orders",
        "bo_products",
        "bo_customers",
    ),
    "top_products": with_tables(
        f"""
SELECT p.name, COUNT(*) AS sales_count FROM bo_order_items i
JOIN bo_products p ON p.id = i.product_id JOIN bo_orders o ON o.id = i.order_id
WHERE o.order_date >= {DAY} - INTERVAL 30 DAY
GROUP BY p.name ORDER BY sales_count DESC, p.name LIMIT 5""",
        "bo_order_items",
        "bo_products",
        "bo_orders",
    ),
    "recent_orders": with_tables(
        """
SELECT o.id, o.order_number, c.name AS customer_name, COUNT(i.product_id) AS items_count,
  CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
  strftime(o.order_date, '%d/%m/%Y') AS formatted_date
FROM bo_orders o JOIN bo_customers c ON c.id = o.customer_id
LEFT JOIN bo_order_items i ON i.order_id = o.id
GROUP BY o.id, o.order_number, c.name, o.total_amount, o.status, o.order_date
ORDER BY o.order_date DESC, o.id DESC LIMIT 25 OFFSET 25""",
        "bo_orders",
        "bo_customers",
        "bo_order_items",
    ),
    "recent_orders_after": with_tables(
        f"""
SELECT o.id, o.order_number, c.name AS customer_name, COUNT(i.product_id) AS items_count,
  CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
  strftime(o.order_date, '%d/%m/%Y') AS formatted_date
FROM bo_orders o JOIN bo_customers c ON c.id = o.customer_id
LEFT JOIN bo_order_items i ON i.order_id = o.id
WHERE (o.order_date, o.id) < (TIMESTAMP '{ORDERS_SEEN[0]}', {ORDERS_SEEN[1]})
GROUP BY o.id, o.order_number, c.name, o.total_amount, o.status, o.order_date
ORDER BY o.order_date DESC, o.id DESC LIMIT 25""",
        "bo_orders",
        "bo_customers",
        "bo_order_items",
    ),
    "recent_orders_total": with_tables("SELECT COUNT(*) AS total FROM bo_orders", "bo_orders"),
    "low_stock": with_tables(
        """
SELECT id, name, category, current_stock, minimum_stock, unit FROM bo_products
WHERE current_stock < minimum_stock
ORDER BY CASE WHEN minimum_stock <> 0 THEN current_stock::DOUBLE / minimum_stock END ASC NULLS FIRST, id
LIMIT 5""",
        "bo_products",
    ),
    "sales_by_weekday": with_tables(
        f"""
SELECT CAST(dayofweek(order_date) + 1 AS INT) AS dow, dayname(order_date) AS day,
  CAST(SUM(total_amount) AS DOUBLE) AS total
FROM bo_orders WHERE date_trunc('week', order_date) = date_trunc('week', {DAY}) GROUP BY 1, 2""",
        "bo_orders",
    ),
    "sales_by_month_day": with_tables(
        f"""
SELECT CAST(DAY(order_date) AS INT) AS day, CAST(SUM(total_amount) AS DOUBLE) AS total
FROM bo_orders WHERE MONTH(order_date) = MONTH({DAY}) AND YEAR(order_date) = YEAR({DAY}) GROUP BY 1""",
        "bo_orders",
    ),
    "sales_by_year_month": with_tables(
        f"""
SELECT monthname(order_date) AS month, CAST(SUM(total_amount) AS DOUBLE) AS total
FROM bo_orders WHERE YEAR(order_date) = YEAR({DAY}) GROUP BY 1""",
        "bo_orders",
    ),
    "sales_totals": with_tables(
        f"""
SELECT
  CAST(COALESCE(SUM(CASE WHEN CAST(order_date AS DATE) = {DAY} THEN total_amount END), 0) AS DOUBLE) AS today,
  CAST(COALESCE(SUM(CASE WHEN date_trunc('week', CAST(order_date AS DATE) + 1)
    = date_trunc('week', {DAY} + 1) THEN total_amount END), 0) AS DOUBLE) AS week,
  CAST(COALESCE(SUM(CASE WHEN MONTH(order_date) = MONTH({DAY}) AND YEAR(order_date) = YEAR({DAY})
    THEN total_amount END), 0) AS DOUBLE) AS month,
  COUNT(CASE WHEN status IN ('pending', 'preparing') THEN 1 END) AS pending
FROM bo_orders""",
        "bo_orders",
    ),
    "sales_documents": with_tables(
        """
, lines AS (SELECT i.order_id, string_agg(concat_ws(':', p.name, CAST(i.quantity AS VARCHAR),
    CAST(i.unit_price AS VARCHAR)), ',' ORDER BY p.name, i.quantity, i.unit_price) AS items
  FROM bo_order_items i JOIN bo_products p ON p.id = i.product_id GROUP BY i.order_id)
SELECT o.id, o.order_number, o.status, CAST(o.total_amount AS DOUBLE) AS total_amount,
  strftime(o.order_date, '%Y-%m-%dT%H:%M:%S.%gZ') AS order_date, o.channel, c.name AS customer_name,
  o.ifood_order, 0 AS part, COALESCE(l.items, '') AS items
FROM bo_orders o LEFT JOIN bo_customers c ON c.id = o.customer_id LEFT JOIN lines l ON l.order_id = o.id""",
        "bo_orders",
        "bo_customers",
        "bo_order_items",
        "bo_products",
    ),
    "sale_details": with_tables(
        """
, lines AS (SELECT i.order_id, string_agg(concat_ws(':', CAST(p.id AS VARCHAR), p.name,
    CAST(i.quantity AS VARCHAR), CAST(i.unit_price AS VARCHAR)), ','
    ORDER BY p.id, p.name, i.quantity, i.unit_price) AS items
  FROM bo_order_items i JOIN bo_products p ON p.id = i.product_id GROUP BY i.order_id)
SELECT o.id, o.order_number, o.customer_id, CAST(o.total_amount AS DOUBLE) AS total_amount, o.status,
  o.observations, o.channel, o.order_date, o.whatsapp_number, o.ifood_order, o.attendant, o.payment_method,
  CAST(o.amount_received AS DOUBLE) AS amount_received, CAST(o.change_given AS DOUBLE) AS change_given,
  c.name AS customer_name, o.customer_id AS customer, 0 AS part, COALESCE(l.items, '') AS items
FROM bo_orders o LEFT JOIN bo_customers c ON c.id = o.customer_id LEFT JOIN lines l ON l.order_id = o.id
WHERE o.id IN (SELECT order_id FROM bo_order_items)""",
        "bo_orders",
        "bo_customers",
        "bo_order_items",
        "bo_products",
    ),
    "ingredient_picker": with_tables(
        "SELECT id, name, category, unit FROM bo_products WHERE category = 'Ingredientes'", "bo_products"
    ),
    "product_search": with_tables(
        f"SELECT *, {_LABEL} FROM bo_products WHERE {_LOW_RING} ORDER BY name, id LIMIT 20", "bo_products"
    ),
    "product_search_category": with_tables(
        f"SELECT *, {_LABEL} FROM bo_products WHERE lower(category) = 'promo' ORDER BY name, id LIMIT 50 OFFSET 50",
        "bo_products",
    ),
    "product_search_total": with_tables(
        f"SELECT COUNT(*) AS total FROM bo_products WHERE {_LOW_RING}", "bo_products"
    ),
    "stock_counts": with_tables(
        """
SELECT COUNT(*) AS total, COUNT(CASE WHEN current_stock < minimum_stock AND current_stock > 0 THEN 1 END) AS low,
  COUNT(CASE WHEN current_stock = 0 THEN 1 END) AS out FROM bo_products""",
        "bo_products",
    ),
    "product_categories": with_tables("SELECT DISTINCT category FROM bo_products", "bo_products"),
    "product_lookup": with_tables(
        "SELECT * FROM bo_products WHERE id IN (SELECT user_id FROM events)", "bo_products"
    ),
    "recipe_list": with_tables(
        f"""
SELECT r.id, r.name, r.category, r.prep_time, r.image_url, COUNT(i.id) AS ingredients_count,
  CAST(SUM(CASE WHEN p.current_stock = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_ingredients
FROM (SELECT * FROM bo_recipes WHERE {_RECIPE_1} ORDER BY name, id LIMIT 30) r
LEFT JOIN bo_recipe_ingredients i ON i.recipe_id = r.id LEFT JOIN bo_products p ON p.id = i.product_id
GROUP BY r.id, r.name, r.category, r.prep_time, r.image_url""",
        "bo_recipes",
        "bo_recipe_ingredients",
        "bo_products",
    ),
    "recipe_list_total": with_tables(
        f"SELECT COUNT(*) AS total FROM bo_recipes WHERE {_RECIPE_1}", "bo_recipes"
    ),
    "recipe_categories": with_tables("SELECT DISTINCT category FROM bo_recipes", "bo_recipes"),
    "recipe_counts": with_tables(
        f"""
SELECT (SELECT COUNT(*) FROM bo_recipes) AS total,
  (SELECT COUNT(DISTINCT r.id) FROM bo_recipes r JOIN bo_recipe_log l ON l.recipe_id = r.id
    WHERE l.action = 'prepared' AND l.created_at >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 30 DAY) AS popular,
  (SELECT COUNT(DISTINCT r.id) FROM bo_recipes r JOIN bo_recipe_ingredients i ON i.recipe_id = r.id
    JOIN bo_products p ON p.id = i.product_id WHERE p.current_stock = 0) AS missing""",
        "bo_recipes",
        "bo_recipe_log",
        "bo_recipe_ingredients",
        "bo_products",
    ),
    "recipe_details": with_tables(
        """
, used AS (SELECT i.recipe_id, string_agg(concat_ws(':', CAST(i.id AS VARCHAR), p.name,
    CAST(i.quantity AS VARCHAR), i.unit, i.notes, CAST(p.id AS VARCHAR),
    CASE WHEN p.current_stock = 0 THEN '1' ELSE '0' END), ',' ORDER BY i.id) AS ingredients
  FROM bo_recipe_ingredients i JOIN bo_products p ON p.id = i.product_id GROUP BY i.recipe_id)
SELECT r.*, 0 AS part, COALESCE(u.ingredients, '') AS ingredients
FROM bo_recipes r LEFT JOIN used u ON u.recipe_id = r.id""",
        "bo_recipes",
        "bo_recipe_ingredients",
        "bo_products",
    ),
    "tasks_upcoming": with_tables(
        f"""
SELECT t.* REPLACE (strftime(t.due_date, '%Y-%m-%dT%H:%M:%S.000Z') AS due_date),
  c.name AS category_name, c.color AS category_color
FROM bo_tasks t LEFT JOIN bo_task_categories c ON c.id = t.category_id
WHERE t.due_date BETWEEN TIMESTAMP '{TASKS_FROM}' AND TIMESTAMP '{TASKS_TO}' AND t.status <> 'completed'""",
        "bo_tasks",
        "bo_task_categories",
    ),
    "tasks_search": with_tables(
        f"""
SELECT t.id, t.title, t.description, strftime(t.due_date, '%Y-%m-%dT%H:%M:%S.000Z') AS due_date, t.priority,
  t.status, t.category_id, t.reminder_minutes, c.name AS category_name, c.color AS category_color
FROM (SELECT * FROM bo_tasks WHERE {_OVERDUE_ERROR}
  ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 0 END, id LIMIT 50) t
LEFT JOIN bo_task_categories c ON c.id = t.category_id""",
        "bo_tasks",
        "bo_task_categories",
    ),
    "tasks_search_total": with_tables(
        f"SELECT COUNT(*) AS total FROM bo_tasks WHERE {_OVERDUE_ERROR}", "bo_tasks"
    ),
    "tasks_search_deep_page": with_tables(
        """
SELECT t.id, t.title, t.description, strftime(t.due_date, '%Y-%m-%dT%H:%M:%S.000Z') AS due_date, t.priority,
  t.status, t.category_id, t.reminder_minutes, c.name AS category_name, c.color AS category_color
FROM (SELECT * FROM bo_tasks ORDER BY due_date DESC, id DESC LIMIT 200 OFFSET 1000) t
LEFT JOIN bo_task_categories c ON c.id = t.category_id""",
        "bo_tasks",
        "bo_task_categories",
    ),
    "tasks_summary": with_tables(
        f"""
SELECT COUNT(*) AS total, COUNT(CASE WHEN status = 'completed' THEN 1 END) AS completed,
  COUNT(CASE WHEN status <> 'completed' THEN 1 END) AS pending,
  COUNT(CASE WHEN due_date < TIMESTAMP '{TASKS_AS_OF}' AND status <> 'completed' THEN 1 END) AS overdue
FROM bo_tasks""",
        "bo_tasks",
    ),
    "finance_summary": with_tables(
        f"""
, l AS (SELECT {_INCOME} AS i, {_EXPENSE} AS e FROM bo_ledger WHERE transaction_date {_IN_HALF})
SELECT CAST(i AS DOUBLE) AS total_income, CAST(e AS DOUBLE) AS total_expenses, CAST(i - e AS DOUBLE) AS balance,
  (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) FROM bo_orders
    WHERE CAST(order_date AS DATE) {_IN_HALF}) AS total_revenue FROM l""",
        "bo_ledger",
    ),
    "finance_summary_unbounded": with_tables(
        f"""
, l AS (SELECT {_INCOME} AS i, {_EXPENSE} AS e FROM bo_ledger)
SELECT CAST(i AS DOUBLE) AS total_income, CAST(e AS DOUBLE) AS total_expenses, CAST(i - e AS DOUBLE) AS balance,
  (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) FROM bo_orders) AS total_revenue FROM l""",
        "bo_ledger",
    ),
    "cashflow_by_month": with_tables(
        f"""
SELECT strftime(transaction_date, '%Y-%m') AS month_year, CAST({_INCOME} AS DOUBLE) AS total_income,
  CAST({_EXPENSE} AS DOUBLE) AS total_expenses
FROM bo_ledger WHERE transaction_date >= DATE '1998-01-01' GROUP BY 1""",
        "bo_ledger",
    ),
    "category_distribution": with_tables(
        f"""
SELECT category, CAST({_EXPENSE} AS DOUBLE) AS total_expenses, CAST({_INCOME} AS DOUBLE) AS total_income
FROM bo_ledger WHERE transaction_date {_IN_HALF} GROUP BY category HAVING {_EXPENSE} > 0 OR {_INCOME} > 0""",
        "bo_ledger",
    ),
    "transactions_search": with_tables(
        f"""
SELECT id, description, CAST(amount AS DOUBLE) AS amount, type, category,
  strftime(transaction_date, '%Y-%m-%d') AS date FROM bo_ledger
WHERE transaction_date BETWEEN DATE '{MONTH[0]}' AND DATE '{MONTH[1]}' AND type = 'saida'
ORDER BY bo_ledger.amount DESC, id DESC""",
        "bo_ledger",
    ),
    "transactions_search_category": with_tables(
        f"""
SELECT id, description, CAST(amount AS DOUBLE) AS amount, type, category,
  strftime(transaction_date, '%Y-%m-%d') AS date FROM bo_ledger
WHERE transaction_date >= DATE '{HALF_YEAR[0]}' AND category = 'impostos'""",
        "bo_ledger",
    ),
    "transaction_lookup": with_tables(
        """
SELECT id, description, CAST(amount AS DOUBLE) AS amount, type, category,
  strftime(transaction_date, '%Y-%m-%d') AS transaction_date FROM bo_ledger
WHERE id IN (SELECT 1000000000000 + order_id * 100 + line_number FROM bo_order_items)""",
        "bo_ledger",
        "bo_order_items",
    ),
    "oil_impact": with_tables(
        f"""
, o AS (SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS t FROM bo_oil_disposals
  WHERE MONTH(disposal_date) = MONTH({DAY}))
SELECT t AS "totalOil", t * 1.5::DOUBLE AS "co2Saved", t * 25000 AS "waterSaved" FROM o""",
        "bo_oil_disposals",
    ),
    "oil_impact_same_year": with_tables(
        f"""
, o AS (SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS t FROM bo_oil_disposals
  WHERE MONTH(disposal_date) = MONTH({DAY}) AND YEAR(disposal_date) = YEAR({DAY}))
SELECT t AS "totalOil", t * 1.5::DOUBLE AS "co2Saved", t * 25000 AS "waterSaved" FROM o""",
        "bo_oil_disposals",
    ),
    "recent_disposals": with_tables(
        """
SELECT id, product, CAST(amount AS DOUBLE) AS amount, disposal_date, notes FROM bo_oil_disposals
ORDER BY disposal_date DESC, id DESC LIMIT 10""",
        "bo_oil_disposals",
    ),
}
