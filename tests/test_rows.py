"""Numbering, running sums, paging and nesting."""

import random

import pytest
from pyspark.sql import functions as F
from shop import frame, rows

from tallybook.functions import rows as helpers
from tallybook.functions.rows import dense_index, nest, paginate, sum_before


def test_dense_index_numbers_all_and_within_groups(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 500)
    # One group holds most of the rows.
    data = [(k, "hot" if i % 5 else f"g{i % 3}") for i, k in enumerate(keys)]
    df = frame(spark, "k bigint, g string", data).repartition(7)
    found = rows(dense_index(df, [F.desc("k")], "n", ["g"], "m"))
    assert len(found) == 500
    want = sorted(data, reverse=True)
    seen = {}
    for n, (k, g) in enumerate(want):
        seen[k] = (n, sum(1 for _, other in want[:n] if other == g))
    assert {k: (n, m) for k, _, n, m in found} == seen


def test_dense_index_of_nothing(spark):
    assert rows(dense_index(frame(spark, "k bigint", []), [F.col("k")], "n")) == []


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_sum_before_does_not_depend_on_blocks(spark, block):
    rng = random.Random(2)
    data = [(i, "a" if rng.random() < 0.7 else "b", rng.randint(0, 9)) for i in range(60)]
    df = frame(spark, "pos bigint, k string, v bigint", data)
    found = {(p, k): before for p, k, _, before in rows(sum_before(df, "k", "pos", ["v"], block))}
    assert found == {
        (p, k): sum(v for q, other, v in data if other == k and q < p) for p, k, _ in data
    }


def test_only_wide_keys_are_cut_into_blocks(spark):
    """Keys of few rows bring no totals of their own along, however short the blocks are."""
    data = [(i, "a" if i % 3 else "b", i) for i in range(60)]
    df = frame(spark, "pos bigint, k string, v bigint", data).withColumn("wide", F.col("k") == "a")
    found = sum_before(df, "k", "pos", ["v"], 4, "wide")
    want = {(p, k): sum(v for q, other, v in data if other == k and q < p) for p, k, _ in data}
    assert {(r["pos"], r["k"]): r["v_before"] for r in found.collect()} == want
    narrow = sum_before(df.withColumn("wide", F.lit(False)), "k", "pos", ["v"], 4, "wide")
    assert {(r["pos"], r["k"]): r["v_before"] for r in narrow.collect()} == want


def test_nest_cuts_every_key_the_same_way(spark):
    data = [(1, i) for i in range(53)] + [(2, 7), (2, 3)] + [(3, 5)] * 25
    random.Random(3).shuffle(data)
    df = frame(spark, "k bigint, v bigint", data).repartition(5)
    found = sorted(rows(nest(df, "k", [F.col("v")], "vs", part_rows=10)))
    parts = {(k, part): [r["v"] for r in vs] for k, part, vs in found}
    assert {p: vs for (k, p), vs in parts.items() if k == 1} == {
        p: list(range(53))[10 * p : 10 * p + 10] for p in range(6)
    }
    assert parts[2, 0] == [3, 7]
    assert [len(vs) for (k, _), vs in parts.items() if k == 3] == [10, 10, 5]


def test_deep_pages_equal_near_ones(spark, monkeypatch):
    df = frame(spark, "id bigint", [(i,) for i in range(100)]).repartition(5)
    near = rows(paginate(df, [F.desc("id")], 4, 9))
    monkeypatch.setattr(helpers, "TOP_K_ROWS", 0)
    assert rows(paginate(df, [F.desc("id")], 4, 9)) == near == [(99 - i,) for i in range(27, 36)]
    assert rows(paginate(df, [F.desc("id")], 40, 9)) == []


@pytest.mark.parametrize("page,limit", [(0, 5), (1, 0), (-1, 5)])
def test_pages_start_at_one(spark, page, limit):
    with pytest.raises(ValueError):
        paginate(frame(spark, "id bigint", []), [F.asc("id")], page, limit)
