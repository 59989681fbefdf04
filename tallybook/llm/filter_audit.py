"""How filters interact: who removes what in every order, by min-plus removal ranks.

A row that fails some filters is removed, in a given order, at the place of the first of them. With
a mask matrix (0 where a class of rows fails a filter, infinite where it passes) and a position
matrix (the inverse permutation of each order: the place of every filter in it), the removal step
is their min-plus product: the minimum over filters of mask plus position. Rows alike in part and
failures are one class with a weight, so the product is over classes, not rows; the steps then say
where the weights are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import prepare, quoted
from tallybook.sources.scratch import materialize

MEASURES = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
# The five text filters, in the order of their letters.
TEXT_FILTERS = "ABCDE"


def audit_filters(
    rows: DataFrame, filters: str, part: Column, good: Column, toxic: Column, orders: Sequence[str] | None = None
) -> DataFrame:
    """Counts for every part, order and step. ``rows`` has a boolean column for each letter of ``filters``.

    A true value means the row fails that filter; null counts as false. ``part`` names the part a
    row counts in (null: the empty string), ``good`` and ``toxic`` what is counted as lost (null:
    not). ``orders`` are strings of the letters, all permutations by default. Each part there is
    has a row for every order and step, zeros included; no rows give no parts.

    ``kept`` rows are left after the step, ``removed`` go at it, ``redundant`` ones fail its filter
    but went before, ``unique_fails`` fail no other filter; ``shapley`` is what its filter removes,
    at any step, over all ``orders``. At most ``2 ** len(filters)`` classes of a part meet in a task.
    """
    if len(set(filters)) != len(filters) or not filters:
        raise ValueError(f"filters must be different letters, got {filters!r}")
    orders = ["".join(p) for p in permutations(filters)] if orders is None else list(orders)
    if any(sorted(o) != sorted(filters) for o in orders):
        raise ValueError("every order must name every filter once")
    fails = [F.coalesce(quoted(letter), F.lit(False)).cast("boolean").alias(f"_f{i}") for i, letter in enumerate(filters)]
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    marked = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"), *fails, good.alias("_good"), toxic.alias("_toxic")
    )
    classes = marked.groupBy("part", *[f"_f{i}" for i in range(len(filters))]).agg(
        F.count(F.lit(1)).alias("rows"), one(F.col("_good")).alias("good"), one(F.col("_toxic")).alias("toxic")
    )
    return classes.groupBy("part").applyInPandas(_count(filters, orders), MEASURES)


def position_matrix(filters: str, orders: Sequence[str]) -> np.ndarray:
    """Place of every filter (columns) in every order (rows): the inverse permutations."""
    listed = np.array([[filters.index(letter) for letter in order] for order in orders], dtype=np.int64)
    return np.argsort(listed, axis=1)


def removal_steps(fails: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product: for every class and order the place that removes it, infinite if none does."""
    mask = np.where(fails, 0.0, np.inf)
    return (mask[:, None, :] + position[None, :, :]).min(axis=2)


def _count(filters: str, orders: list[str]):
    def run(classes: pd.DataFrame) -> pd.DataFrame:
        width = len(filters)
        fails = classes[[f"_f{i}" for i in range(width)]].to_numpy(dtype=bool)
        position = position_matrix(filters, orders)
        at = np.argsort(position, axis=1)  # the filter at each step of an order
        step = removal_steps(fails, position)
        gone, order = np.nonzero(np.isfinite(step))
        place = (order, step[gone, order].astype(np.int64))
        lost = {}
        for name in ("rows", "good", "toxic"):
            weight = classes[name].to_numpy(dtype=np.int64)
            lost[name] = np.zeros((len(orders), width), dtype=np.int64)
            np.add.at(lost[name], place, weight[gone])
        weight = classes["rows"].to_numpy(dtype=np.int64)
        failing = weight @ fails
        alone = weight @ (fails & (fails.sum(axis=1, keepdims=True) == 1))
        shapley = np.zeros(width, dtype=np.int64)
        np.add.at(shapley, at, lost["rows"])
        removed = lost["rows"]
        return pd.DataFrame(
            {
                "part": classes["part"].iloc[0],
                "filter_order": np.repeat(orders, width),
                "step": np.tile(np.arange(1, width + 1, dtype=np.int32), len(orders)),
                "kept": (weight.sum() - removed.cumsum(axis=1)).ravel(),
                "removed": removed.ravel(),
                "redundant": (failing[at] - removed).ravel(),
                "unique_fails": alone[at].ravel(),
                "good_lost": lost["good"].ravel(),
                "toxic_lost": lost["toxic"].ravel(),
                "shapley": shapley[at].ravel(),
            }
        )

    return run


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``id``, the columns of ``keep`` as ``_keep0`` … and a boolean for each of the five text filters.

    A: under 200 words; B: distinct words under half of all; C: A-Z over 3 in 100 code points;
    D: any of ``#$%&*|``; E: the text of a row with a smaller id, in the whole table. Words are
    what ASCII white space parts, case counts, and a null text is an empty one. A row without an
    id is no copy and no row's original; rows of one id are not copies of each other.
    """
    prepare(docs.sparkSession)
    own = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
        *[quoted(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
    )
    digested = own.select("*", F.unhex(F.sha2("text", 256)).alias("digest"))
    kept = [f"_keep{i}" for i in range(len(keep))]
    fields = ["id", *kept, "digest"]
    types = {f.name: f.dataType.simpleString() for f in digested.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in fields) + ", A boolean, B boolean, C boolean, D boolean"
    rows = materialize(digested.mapInArrow(_text_filters(fields), schema), "failures")
    # Written by itself, so that the copies of one text can be split between tasks in the join.
    first = materialize(rows.groupBy("digest").agg(F.min("id").alias("_first")), "originals")
    copy = F.coalesce(F.col("_first") < F.col("id"), F.lit(False)).alias("E")
    return rows.join(first, "digest").select("id", *kept, "A", "B", "C", "D", copy)


_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = frozenset("#$%&*|")


def _text_filters(fields: Sequence[str]):
    def of_text(text: str) -> tuple[bool, bool, bool, bool]:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        return (
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(raw.translate(None, _CAPITAL)) > 3 * len(text),
            any(mark in text for mark in _MARKS),
        )

    def run(batches):
        for rows in batches:
            found = [of_text(t.as_py()) for t in rows.column("text")]
            columns = [rows.column(c) for c in fields]
            columns += [pa.array(c, type=pa.bool_()) for c in (zip(*found) if found else [[]] * 4)]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "A", "B", "C", "D"])

    return run


def audit_text_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """The five text filters over ``docs``, in all 120 orders, in every part.

    ``labels`` has ``id_col``, ``quality`` and ``toxic``; of several rows of one id any 1 counts,
    a document without labels is neither good nor toxic.
    """
    known = labels.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = text_failures(docs, id_col, keep=[part_col]).join(known, "id", "left")
    return audit_filters(rows, TEXT_FILTERS, F.col("_keep0"), F.col("good"), F.col("toxic"))
