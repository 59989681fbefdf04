"""Stock for incoming orders, first come first served, over a whole batch at once.

An order is taken only if every one of its lines finds enough stock at its turn, and only
orders that are taken use stock up, so whether an order is taken depends on all the earlier
ones. The batch is settled in rounds. For every open order and product, a round knows two
bounds of the stock left at that order's turn:

* ``most``  = stock − what earlier *taken* orders use
* ``least`` = ``most`` − what earlier *open* orders might use

An order with a line above ``most`` is refused; an order whose lines all fit into ``least`` is
taken. A round brings the rows of a product together once and those of an order once, writes one
table, the open rows with their bounds, and puts the rows it settles into one folder.

The rows of the batch are written bucketed by product, so that the first round of a turn has them
together already. Where a product has more lines than a block they are not, as its rows are shared.

A large batch is settled in a few turns, earlier orders first. A turn knows what the turns before it
left of every product, so that most of its orders are settled by the first round, and only its own
rows take part in it.

Rounds go on as long as each settles a fair share of what is open. A chain of orders that hang on
each other's outcome would then go on one by one, so what is left is split into components, orders
linked through scarce products, and every component is walked in order by a task of its own, up to
a stated number of rows. So the number of rounds does not grow with the length of chains: a walk
settles all of a component, or that many of its rows. A few rows that rounds leave over are walked
at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.functions.graph import components
from tallybook.functions.rows import dense_index, sum_before
from tallybook.sources.scratch import deal, materialize, materialize_by, scratch_path

# Orders per block of a running sum: what one task sums of one product.
BLOCK_ORDERS = 100_000
# Rows of one component that a task walks at once.
WALK_ROWS = 200_000
# Share of the open rows a round must settle for another one to follow.
ROUND_SHARE = 0.2
# Rows left over by a round that one task walks without asking for their components.
TAIL_ROWS = 20_000
# Turns a batch is settled in at most, and the rows from which on there is one more.
TURNS = 4
TURN_ROWS = 1_000_000

_OPEN = ["seq", "product_id", "demand", "need", "most", "wide"]
_ROWS = "seq bigint, product_id bigint, demand bigint, need bigint, most bigint, wide boolean, accepted boolean"


class Allocation(NamedTuple):
    decisions: DataFrame  # feed_id, accepted
    shortages: DataFrame  # feed_id, product_id, product, available, requested


def _bounded(rows: DataFrame, block_orders: int | None) -> DataFrame:
    """Open rows with ``most`` brought up to date, and ``wanted_before``, what earlier open ones ask for.

    What the last step took is deducted from ``most`` of the later rows of its products, once;
    after that neither its rows nor those it refused are needed any more.
    """
    taken = F.coalesce("accepted", F.lit(False))
    current = rows.where(F.col("accepted").isNull() | taken).withColumns(
        {
            "used": F.when(taken, F.col("demand")).otherwise(0),
            "wanted": F.when(taken, 0).otherwise(F.col("demand")),
        }
    )
    return (
        sum_before(current, "product_id", "seq", ["used", "wanted"], block_orders, "wide")
        .where(F.col("accepted").isNull())
        .withColumn("most", F.col("most") - F.col("used_before"))
    )


def _round(rows: DataFrame, block_orders: int | None) -> DataFrame:
    """Open rows with the verdicts their bounds come to."""
    bounded = _bounded(rows, block_orders).select(
        *_OPEN,
        (F.col("need") > F.col("most")).alias("_lacks"),
        (F.col("need") <= F.col("most") - F.col("wanted_before")).alias("_fits"),
    )
    order = Window.partitionBy("seq")
    verdict = F.when(F.max("_lacks").over(order), F.lit(False)).when(F.min("_fits").over(order), F.lit(True))
    return bounded.select(*_OPEN, verdict.alias("accepted"))


def _walk(rows: DataFrame, walk_rows: int) -> DataFrame:
    """Open rows, all with ``most`` of this moment, with the verdicts a walk of each component comes to.

    Of a component of more than ``walk_rows`` rows the first so many are walked, as far as they
    hold whole orders.
    """
    first = rows.groupBy("product_id").agg(F.min("seq").alias("b"))
    links = rows.select("product_id", F.col("seq").alias("a")).join(materialize(first, "first"), "product_id")
    linked = rows.join(components(links.select("a", "b")).withColumnRenamed("node", "seq"), "seq")
    placed = dense_index(
        linked.select(*rows.columns, "root"),
        [F.col("root"), F.col("seq"), F.col("product_id")],
        "_n",
        ["root"],
        "_at",
    )
    # One row more than a walk may hold tells it that its last order may go on.
    walked = placed.where(F.col("_at") <= walk_rows).groupBy("root").applyInPandas(_in_turn(walk_rows), _ROWS)
    later = placed.where(F.col("_at") > walk_rows).select(*rows.columns)
    return walked.unionByName(later, allowMissingColumns=True)


def _walk_at_once(rows: DataFrame, walk_rows: int) -> DataFrame:
    """As ``_walk``, for at most ``walk_rows`` rows in all."""
    return rows.withColumn("root", F.lit(0)).groupBy("root").applyInPandas(_in_turn(walk_rows), _ROWS)


def _in_turn(walk_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Orders of one component one after the other, against what each product has left."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "product_id"])
        cut = rows["seq"].iloc[-1] if len(rows) > walk_rows else None
        lines = rows[["seq", "product_id", "demand", "need", "most"]].itertuples(index=False, name=None)
        taken: dict[int, int] = {}  # per product, what orders taken in this walk use
        verdicts = {}
        for seq, asked in groupby(lines, itemgetter(0)):
            if seq == cut:
                break
            asked = list(asked)
            verdicts[seq] = all(need <= most - taken.get(product, 0) for _, product, _, need, most in asked)
            if verdicts[seq]:
                for _, product, demand, _, _ in asked:
                    taken[product] = taken.get(product, 0) + demand
        found = rows["seq"].map(verdicts).astype("boolean")
        return rows[_OPEN].assign(accepted=found)

    return walk


def allocate_stock(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    strict: bool = False,
    block_orders: int = BLOCK_ORDERS,
    walk_rows: int = WALK_ROWS,
) -> Allocation:
    """Settle a batch. ``orders``: feed_id, arrival_seq; ``items``: feed_id, product_id, quantity.

    Each line is checked alone, so two lines of one product may together exceed the stock;
    ``strict`` checks their sum instead. Quantities must be positive. ``walk_rows`` bounds what a
    task walks of one component; it must hold the lines of more than one order.
    """
    numbered = dense_index(
        orders.select("feed_id", "arrival_seq"),
        [F.col("arrival_seq"), F.col("feed_id")],
        "seq",
        keep=["feed_id"],
    )
    lines = items.select("feed_id", "product_id", "quantity").join(
        orders.select("feed_id"), "feed_id", "left_semi"
    )
    stock = products.select(
        F.col("id").alias("product_id"), F.col("current_stock").cast("bigint").alias("stock")
    )
    # Only products that could run out need any bookkeeping; those of very many lines are shared.
    scarce = (
        lines.groupBy("product_id")
        .agg(F.sum("quantity").alias("_total"), F.count(F.lit(1)).alias("_lines"))
        .join(stock, "product_id")
        .where(F.col("_total") > F.col("stock"))
        .select("product_id", "stock", (F.col("_lines") > block_orders).alias("wide"))
    )
    scarce = materialize(scarce, "scarce")
    shared = None if scarce.where("wide").isEmpty() else block_orders
    need = F.sum("quantity") if strict else F.max("quantity")
    # Lines shrink to one row per order and product before a best-seller's meet at its stock.
    asked = (
        lines.groupBy("feed_id", "product_id")
        .agg(F.sum("quantity").alias("demand"), need.cast("bigint").alias("need"))
        .join(numbered, "feed_id")
        .select("seq", "product_id", "demand", "need")
    )
    if shared:
        all_rows = materialize(asked.join(scarce, "product_id"), "demand")
    else:
        all_rows = materialize_by(deal(asked, "product_id").join(scarce, "product_id"), "product_id", "demand")
    folder = scratch_path(all_rows.sparkSession, "settled")
    for first, rows in _turns(all_rows, folder):
        _settle(rows, folder, first, shared, walk_rows)
    settled = _settled(all_rows, folder).select("seq", "accepted").distinct()
    verdicts = materialize(
        numbered.join(settled, "seq", "left").select(
            "feed_id", "seq", F.coalesce("accepted", F.lit(True)).alias("accepted")
        ),
        "verdicts",
    )
    return Allocation(
        verdicts.select("feed_id", "accepted"),
        _shortages(all_rows, verdicts, items, products, strict, shared),
    )


def _settled(rows: DataFrame, folder: str) -> DataFrame:
    kinds = "seq bigint, product_id bigint, demand bigint, accepted boolean"
    return rows.sparkSession.read.schema(kinds).option("recursiveFileLookup", "true").parquet(folder)


def _turns(all_rows: DataFrame, folder: str) -> Iterator[tuple[int, DataFrame]]:
    """The rows of each turn, with the first position of its orders, less what earlier turns used."""
    count, last = all_rows.agg(F.count(F.lit(1)), F.max("seq")).first()
    turns = min(TURNS, 1 + count // TURN_ROWS)
    edges = [(last or 0) * i // turns for i in range(turns)] + [(last or 0) + 1]
    for first, end in zip(edges, edges[1:]):
        within = (F.col("seq") >= first) & (F.col("seq") < end)
        rows = all_rows.where(within).withColumnRenamed("stock", "most")
        rows = rows.select(*_OPEN, F.lit(None).cast("boolean").alias("accepted"))
        if first:
            taken = _settled(all_rows, folder).where("accepted").groupBy("product_id")
            used = materialize(taken.agg(F.sum("demand").alias("_used")), "used")
            left = (F.col("most") - F.coalesce("_used", F.lit(0))).alias("most")
            kept = [left if c == "most" else F.col(c) for c in rows.columns]
            rows = rows.join(used, "product_id", "left").select(*kept)
        yield first, rows


def _settle(rows: DataFrame, folder: str, turn: int, block_orders: int | None, walk_rows: int) -> None:
    """Write the verdicts of all open ``rows`` to a part of ``folder``."""
    walk, few = False, False
    while True:
        if walk:
            left = materialize(_bounded(rows, block_orders).select(*_OPEN), "open")
            rows = _walk_at_once(left, walk_rows) if few else _walk(left, walk_rows)
        else:
            rows = _round(rows, block_orders)
        rows = materialize(rows, "walk" if walk else "round")
        decided = F.col("accepted").isNotNull()
        found = rows.where(decided).select("seq", "product_id", "demand", "accepted")
        found.write.mode("append").parquet(f"{folder}/turn={turn}")
        count, still_open = rows.agg(F.count(F.lit(1)), F.count_if(~decided)).first()
        if not still_open:
            return
        # Where a round no longer gets far, components are walked; a round follows a walk.
        few = still_open <= min(TAIL_ROWS, walk_rows)
        walk = not walk and (few or still_open > (1 - ROUND_SHARE) * count)


def _shortages(
    rows: DataFrame,
    verdicts: DataFrame,
    items: DataFrame,
    products: DataFrame,
    strict: bool,
    block_orders: int | None,
) -> DataFrame:
    """Lines of refused orders that asked for more than was left at their turn.

    With ``strict``, an order's lines of one product are one request.
    """
    judged = rows.join(verdicts, "seq").withColumn(
        "used", F.when(F.col("accepted"), F.col("demand")).otherwise(0)
    )
    at_turn = (
        sum_before(judged, "product_id", "seq", ["used"], block_orders, "wide")
        # A line asks for no more than ``need``, so only such rows can hold one that lacks.
        .where(~F.col("accepted") & (F.col("need") > F.col("stock") - F.col("used_before")))
        .select("feed_id", "product_id", "need", (F.col("stock") - F.col("used_before")).alias("available"))
    )
    if strict:
        asked = at_turn.withColumnRenamed("need", "requested")
    else:
        lines = items.select("feed_id", "product_id", F.col("quantity").alias("requested"))
        asked = lines.join(at_turn.drop("need"), ["feed_id", "product_id"])
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    return (
        asked.where(F.col("requested") > F.col("available"))
        .join(names, "product_id")
        .select("feed_id", "product_id", "product", "available", "requested")
    )
