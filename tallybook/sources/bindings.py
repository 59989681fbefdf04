"""The back-office tables derived from the star-schema test tables.

Every frame reads a whole source table; nothing is sampled, and no binding needs a window.
``SQL`` holds the same bindings for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
        value DOUBLE, props STRING""",
}


def _pick(key: Column, *values: str) -> Column:
    """The value at position ``key`` of the list; the last one for anything beyond."""
    chain = F.when(key == 0, values[0])
    for i, value in enumerate(values[1:-1], start=1):
        chain = chain.when(key == i, value)
    return chain.otherwise(values[-1])


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(10,2)")


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(SOURCE_SCHEMAS[name]).parquet(path)

    @cached_property
    def customers(self) -> DataFrame:
        first = self.source("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderdate").alias("first_order")
        )
        return self.source("customer").join(first, "c_custkey", "left").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.lit(None).cast("string").alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.coalesce("first_order", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")).alias(
                "created_at"
            ),
        )

    @cached_property
    def products(self) -> DataFrame:
        kind, key, size = F.col("p_type"), F.col("p_partkey"), F.col("p_size")
        return self.source("part").select(
            key.alias("id"),
            F.col("p_name").alias("name"),
            F.when(kind == "ECONOMY", "Ingredientes").otherwise(kind).alias("category"),
            F.when(key % 5 == 0, None).otherwise(F.col("p_brand")).alias("description"),
            ((key * 7 + size) % 23).cast("int").alias("current_stock"),
            (size % 12).cast("int").alias("minimum_stock"),
            F.lit("un").alias("unit"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        by_customer, by_key = F.col("o_custkey") % 3, F.col("o_orderkey") % 5
        return self.source("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws(
                "-",
                _pick(by_customer, "WAT", "IFO", "BAL"),
                F.year("o_orderdate").cast("string"),
                F.format_string("%04d", F.col("o_orderkey") + 1),
            ).alias("order_number"),
            F.col("o_custkey").alias("customer_id"),
            _money("o_totalprice").alias("total_amount"),
            _pick(by_key, "pending", "paid", "preparing", "on_delivery", "delivered").alias("status"),
            F.lit(None).cast("string").alias("observations"),
            _pick(by_customer, "whatsapp", "ifood", "balcao").alias("channel"),
            F.col("o_orderdate").alias("order_date"),
            F.lit(None).cast("string").alias("whatsapp_number"),
            F.when(by_customer == 1, F.concat(F.lit("IF"), F.col("o_orderkey").cast("string"))).alias(
                "ifood_order"
            ),
            F.lit(None).cast("string").alias("attendant"),
            _pick(by_key, "dinheiro", "cartao_credito", "cartao_debito", "pix", "outro").alias(
                "payment_method"
            ),
            F.lit(None).cast("decimal(10,2)").alias("amount_received"),
            F.lit(None).cast("decimal(10,2)").alias("change_given"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _money("l_extendedprice").alias("unit_price"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        sales = self.orders.select(
            "id",
            F.concat(
                F.lit("Venda "), F.col("order_number"), F.lit(" ("), F.col("channel"), F.lit(")")
            ).alias("description"),
            F.col("total_amount").alias("amount"),
            F.lit("entrada").alias("type"),
            F.lit("venda").alias("category"),
            F.col("order_date").cast("date").alias("transaction_date"),
        )
        group = F.col("_supplier") % 4
        bought = (
            self.source("lineitem")
            .where(F.col("l_returnflag") == "R")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.sum(_money("l_extendedprice")).cast("decimal(10,2)").alias("amount"),
                F.min("l_suppkey").alias("_supplier"),
                F.min("l_shipdate").alias("_shipped"),
            )
            .select(
                (F.lit(1000000000000) + F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
                F.concat(
                    F.lit("Compra "),
                    F.col("l_orderkey").cast("string"),
                    F.lit("/"),
                    F.col("l_linenumber").cast("string"),
                ).alias("description"),
                "amount",
                F.when((group == 3) & (F.col("l_linenumber") == 1), "entrada")
                .otherwise("saida")
                .alias("type"),
                _pick(group, "despesa", "investimento", "impostos", "outros").alias("category"),
                F.col("_shipped").cast("date").alias("transaction_date"),
            )
        )
        return sales.unionByName(bought)

    @cached_property
    def task_categories(self) -> DataFrame:
        key = F.col("r_regionkey")
        return self.source("region").select(
            key.cast("bigint").alias("id"),
            F.col("r_name").alias("name"),
            _pick(key, "#ef4444", "#22c55e", "#3b82f6").alias("color"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
        return self.source("events").select(
            event.alias("id"),
            F.concat_ws(" ", kind, event.cast("string")).alias("title"),
            F.when(event % 7 == 0, None).otherwise(F.col("props")).alias("description"),
            F.col("ts").alias("due_date"),
            _pick(user % 3, "low", "medium", "high").alias("priority"),
            F.when(kind == "purchase", "completed")
            .when(kind == "click", "in_progress")
            .otherwise("pending")
            .alias("status"),
            F.when(user % 6 == 5, None).otherwise(user % 6).alias("category_id"),
            (event % 4 * 15).cast("int").alias("reminder_minutes"),
        )

    @cached_property
    def recipes(self) -> DataFrame:
        return self.source("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("category"),
            (F.col("c_nationkey") + 10).cast("int").alias("prep_time"),
            F.lit(None).cast("string").alias("image_url"),
            F.concat(F.lit("Modo de preparo "), F.col("c_name")).alias("instructions"),
            F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def recipe_ingredients(self) -> DataFrame:
        return (
            self.source("lineitem")
            .groupBy(F.col("l_suppkey").alias("recipe_id"), F.col("l_partkey").alias("product_id"))
            .agg(F.sum(_money("l_quantity")).cast("decimal(10,2)").alias("quantity"))
            .select(
                (F.col("recipe_id") * 1000000000 + F.col("product_id")).alias("id"),
                "recipe_id",
                "product_id",
                "quantity",
                F.lit("un").alias("unit"),
                F.lit(None).cast("string").alias("notes"),
            )
        )

    @cached_property
    def recipe_log(self) -> DataFrame:
        return self._recipe_actions(self.source("events").where(F.col("event_type").isin("view", "purchase", "click")))

    @cached_property
    def recipe_feed(self) -> DataFrame:
        """Every event as an arriving action, kinds that the log does not know included."""
        return self._recipe_actions(self.source("events"))

    def _recipe_actions(self, events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        return events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("recipe_id"),
            F.when(kind == "view", "viewed")
            .when(kind == "purchase", "prepared")
            .when(kind == "click", "printed")
            .otherwise(F.concat(F.lit("event "), kind))
            .alias("action"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def oil_disposals(self) -> DataFrame:
        return (
            self.source("lineitem")
            .where(F.col("l_returnflag") == "A")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_partkey").alias("_part"),
                F.sum(_money("l_quantity")).cast("decimal(10,2)").alias("amount"),
                F.min("l_shipdate").cast("date").alias("disposal_date"),
            )
            .select(
                (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
                F.concat(F.lit("Oleo "), F.col("_part").cast("string")).alias("product"),
                "amount",
                "disposal_date",
                F.when(F.col("l_linenumber") == 1, None).otherwise("coleta").alias("notes"),
            )
        )

    # -- the sales feed -------------------------------------------------------------------

    @cached_property
    def orders_feed(self) -> DataFrame:
        """Every order as an incoming sale, arriving by date; some lack a status or channel."""
        key, by_customer = F.col("o_orderkey"), F.col("o_custkey") % 3
        by_key = F.col("o_orderkey") % 5
        days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
        return self.source("orders").select(
            key.alias("feed_id"),
            (days * F.lit(1000000000000) + key).alias("arrival_seq"),
            F.when(
                F.col("o_orderpriority") == "1-URGENT",
                F.concat(F.lit("Cliente novo "), F.col("o_custkey").cast("string")),
            )
            .otherwise(F.concat(F.lit("customer#"), F.format_string("%09d", F.col("o_custkey"))))
            .alias("customer"),
            _pick(by_customer, "WhatsApp", "ifood", "BALCAO").alias("channel"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None)
            .otherwise(_pick(by_key, "pending", "paid", "preparing", "on_delivery", "delivered"))
            .alias("status"),
            F.lit(None).cast("string").alias("observations"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("order_date"),
            F.when(by_customer == 0, F.concat(F.lit("+55"), F.col("o_custkey").cast("string"))).alias(
                "whatsapp"
            ),
            F.when(by_customer == 1, F.concat(F.lit("IF"), key.cast("string"))).alias("ifood"),
            F.when(by_customer == 2, F.lit("")).alias("attendant"),
            _pick(by_key, "dinheiro", "cartao_credito", "cartao_debito", "pix", "outro").alias(
                "payment_method"
            ),
            F.col("o_totalprice").alias("amount_received"),
            F.lit(0.5).alias("change_given"),
        )

    @cached_property
    def items_feed(self) -> DataFrame:
        """Every line as a line of its sale; returned lines carry only ``valor``."""
        price, back = _money("l_extendedprice"), F.col("l_returnflag") == "R"
        return self.source("lineitem").select(
            F.col("l_orderkey").alias("feed_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(~back, price).alias("unit_price"),
            F.when(back, price).alias("valor"),
        )


SQL = {
    "bo_customers": """
SELECT c.c_custkey AS id, c.c_name AS name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone,
  COALESCE(f.first_order, TIMESTAMP '1995-01-01 00:00:00') AS created_at
FROM customer c
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
  ON f.o_custkey = c.c_custkey""",
    "bo_products": """
SELECT p_partkey AS id, p_name AS name,
  CASE WHEN p_type = 'ECONOMY' THEN 'Ingredientes' ELSE p_type END AS category,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS description,
  CAST((p_partkey * 7 + p_size) % 23 AS INT) AS current_stock,
  CAST(p_size % 12 AS INT) AS minimum_stock, 'un' AS unit
FROM part""",
    "bo_orders": """
SELECT o_orderkey AS id,
  CONCAT(CASE o_custkey % 3 WHEN 0 THEN 'WAT' WHEN 1 THEN 'IFO' ELSE 'BAL' END, '-',
    CAST(YEAR(o_orderdate) AS VARCHAR), '-', printf('%04d', o_orderkey + 1)) AS order_number,
  o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
  CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'paid' WHEN 2 THEN 'preparing'
    WHEN 3 THEN 'on_delivery' ELSE 'delivered' END AS status,
  CAST(NULL AS VARCHAR) AS observations,
  CASE o_custkey % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'ifood' ELSE 'balcao' END AS channel,
  o_orderdate AS order_date, CAST(NULL AS VARCHAR) AS whatsapp_number,
  CASE WHEN o_custkey % 3 = 1 THEN CONCAT('IF', CAST(o_orderkey AS VARCHAR)) END AS ifood_order,
  CAST(NULL AS VARCHAR) AS attendant,
  CASE o_orderkey % 5 WHEN 0 THEN 'dinheiro' WHEN 1 THEN 'cartao_credito' WHEN 2 THEN 'cartao_debito'
    WHEN 3 THEN 'pix' ELSE 'outro' END AS payment_method,
  CAST(NULL AS DECIMAL(10,2)) AS amount_received, CAST(NULL AS DECIMAL(10,2)) AS change_given
FROM orders""",
    "bo_order_items": """
SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS product_id,
  CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price
FROM lineitem""",
    "bo_ledger": """
SELECT id, CONCAT('Venda ', order_number, ' (', channel, ')') AS description, total_amount AS amount,
  'entrada' AS type, 'venda' AS category, CAST(order_date AS DATE) AS transaction_date
FROM bo_orders
UNION ALL
SELECT 1000000000000 + l_orderkey * 100 + l_linenumber,
  CONCAT('Compra ', CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR)),
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(10,2)),
  CASE WHEN MIN(l_suppkey) % 4 = 3 AND l_linenumber = 1 THEN 'entrada' ELSE 'saida' END,
  CASE MIN(l_suppkey) % 4 WHEN 0 THEN 'despesa' WHEN 1 THEN 'investimento' WHEN 2 THEN 'impostos'
    ELSE 'outros' END,
  CAST(MIN(l_shipdate) AS DATE)
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber""",
    "bo_task_categories": """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name,
  CASE r_regionkey WHEN 0 THEN '#ef4444' WHEN 1 THEN '#22c55e' ELSE '#3b82f6' END AS color
FROM region""",
    "bo_tasks": """
SELECT event_id AS id, CONCAT(event_type, ' ', CAST(event_id AS VARCHAR)) AS title,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS description, ts AS due_date,
  CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority,
  CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'click' THEN 'in_progress'
    ELSE 'pending' END AS status,
  CASE WHEN user_id % 6 = 5 THEN NULL ELSE user_id % 6 END AS category_id,
  CAST(event_id % 4 * 15 AS INT) AS reminder_minutes
FROM events""",
    "bo_recipes": """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, CAST(c_nationkey + 10 AS INT) AS prep_time,
  CAST(NULL AS VARCHAR) AS image_url, CONCAT('Modo de preparo ', c_name) AS instructions,
  CAST(NULL AS VARCHAR) AS notes
FROM customer""",
    "bo_recipe_ingredients": """
SELECT l_suppkey * 1000000000 + l_partkey AS id, l_suppkey AS recipe_id, l_partkey AS product_id,
  CAST(SUM(CAST(l_quantity AS DECIMAL(10,2))) AS DECIMAL(10,2)) AS quantity, 'un' AS unit,
  CAST(NULL AS VARCHAR) AS notes
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "bo_recipe_log": """
SELECT event_id AS id, user_id AS recipe_id,
  CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN 'prepared' ELSE 'printed' END AS action,
  ts AS created_at
FROM events WHERE event_type IN ('view', 'purchase', 'click')""",
    "bo_oil_disposals": """
SELECT l_orderkey * 100 + l_linenumber AS id, CONCAT('Oleo ', CAST(MIN(l_partkey) AS VARCHAR)) AS product,
  CAST(SUM(CAST(l_quantity AS DECIMAL(10,2))) AS DECIMAL(10,2)) AS amount,
  CAST(MIN(l_shipdate) AS DATE) AS disposal_date,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE 'coleta' END AS notes
FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber""",
    "bo_orders_feed": """
SELECT o_orderkey AS feed_id,
  datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 1000000000000 + o_orderkey AS arrival_seq,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CONCAT('Cliente novo ', CAST(o_custkey AS VARCHAR))
    ELSE CONCAT('customer#', printf('%09d', o_custkey)) END AS customer,
  CASE o_custkey % 3 WHEN 0 THEN 'WhatsApp' WHEN 1 THEN 'ifood' ELSE 'BALCAO' END AS channel,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
    ELSE CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'paid' WHEN 2 THEN 'preparing'
      WHEN 3 THEN 'on_delivery' ELSE 'delivered' END END AS status,
  CAST(NULL AS VARCHAR) AS observations, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS order_date,
  CASE WHEN o_custkey % 3 = 0 THEN CONCAT('+55', CAST(o_custkey AS VARCHAR)) END AS whatsapp,
  CASE WHEN o_custkey % 3 = 1 THEN CONCAT('IF', CAST(o_orderkey AS VARCHAR)) END AS ifood,
  CASE WHEN o_custkey % 3 = 2 THEN '' END AS attendant,
  CASE o_orderkey % 5 WHEN 0 THEN 'dinheiro' WHEN 1 THEN 'cartao_credito' WHEN 2 THEN 'cartao_debito'
    WHEN 3 THEN 'pix' ELSE 'outro' END AS payment_method,
  o_totalprice AS amount_received, CAST(0.5 AS DOUBLE) AS change_given
FROM orders""",
    "bo_items_feed": """
SELECT l_orderkey AS feed_id, l_linenumber AS line_no, l_partkey AS product_id,
  CAST(l_quantity AS INT) AS quantity,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(10,2)) END AS unit_price,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(10,2)) END AS valor
FROM lineitem""",
}

# Bindings that read another binding.
_NEEDS = {"bo_ledger": ("bo_orders",)}


def with_tables(body: str, *names: str) -> str:
    """``body`` with the named bindings put before it as common table expressions."""
    wanted: list[str] = []
    for name in names:
        for each in (*_NEEDS.get(name, ()), name):
            if each not in wanted:
                wanted.append(each)
    tables = ",\n".join(f"{name} AS ({SQL[name]})" for name in wanted)
    return f"WITH {tables}\n{body}"
