"""Exact top-k by inner product: pivot tables bound every score, candidates go in bound order.

For a pivot p, distances bound each other: ``|d(q,p) - d(x,p)| <= d(q,x)``. The largest bound
over all pivots bounds the inner product, ``(|q|² + |x|² - d(q,x)²) / 2``, from above. Candidates
of a shard are scored in the order of their bounds until no bound reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.llm.common import batch, prepare, quoted
from tallybook.sources.scratch import materialize

_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_PLACED = "id long, v array<long>, cell int, away double, square double"
_VISITS = "shard long, asks boolean, floor double, id long, v array<long>"
# Products of components below this are summed exactly in doubles.
_EXACT = 1 << 53


def top_inner_products(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = 32,
    shard_rows: int = 16384,
    pivot_sample: int = 2048,
) -> DataFrame:
    """The ``k`` best rows for each row whose id is divisible by ``query_every``.

    Components x count as ``floor(scale * x)``; scores are integer inner products. Returns
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller id, a query is
    no candidate of its own, and all come out if there are fewer than ``k``. Rows without an id,
    and null, empty-component or non-finite vectors, take no part. Vectors are compared with those
    of their own dimension only. Repeated rows of one id count as one if they are equal; different
    vectors of one id each keep their score, the best of them counts. Integer components beyond
    2**31 and scores beyond 64 bits raise an error.

    Pivots are chosen from at most about ``pivot_sample`` vectors and change no result. Candidates
    lie in the cell of their nearest pivot, in shards of about ``shard_rows``. A query first takes
    its ``k``-th best score in the sample as its floor, and leaves out every cell whose distances
    from its pivot show that no score there reaches the floor. Queries are read in blocks.
    """
    prepare(vectors.sparkSession)
    vector = quoted(vector_col)
    usable = quoted(id_col).isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    )
    whole = vectors.where(usable).select(
        quoted(id_col).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).cast("array<long>").alias("v"),
    )
    whole = materialize(whole.distinct(), "vectors")
    count = whole.count()
    share = min(1.0, pivot_sample / max(count, 1))
    sample = whole.sample(False, share, 11).orderBy("id").limit(2 * pivot_sample).collect()
    table = _pivots([r["v"] for r in sample], pivots)
    placed = materialize(whole.mapInArrow(_place(table), _PLACED), "cells")
    # At most one row for each pivot, and one for vectors of a dimension that the sample lacks.
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"), F.max("square").alias("square")
    )
    cells = sorted((r["cell"], -(-r["n"] // shard_rows), r["low"], r["high"], r["square"]) for r in cells.collect())
    first = dict(zip([c[0] for c in cells], np.cumsum([0, *[c[1] for c in cells]]).tolist()))
    dealing = F.broadcast(
        vectors.sparkSession.createDataFrame([(c[0], first[c[0]], c[1]) for c in cells], "cell int, first long, parts long")
    )
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).alias("shard")
    nothing = F.lit(float("-inf")).alias("floor")
    candidates = placed.join(dealing, "cell").select(shard, F.lit(False).alias("asks"), nothing, "id", "v")
    queries = whole.where(F.col("id") % query_every == 0)
    visits = queries.mapInArrow(_visits(table, cells, first, _by_size(sample), k), _VISITS)
    dealt = candidates.unionByName(visits).repartition("shard").sortWithinPartitions("shard", "asks", "id")
    best = dealt.mapInArrow(_search(table, k), "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _pivots(sample: list[list[int]], pivots: int) -> dict[int, np.ndarray]:
    """For each dimension, vectors of the sample far from each other."""
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    chosen = {}
    for size, rows in by_size.items():
        rows = np.array(rows, dtype=np.float64).reshape(len(rows), size)
        picked, away = [], np.full(len(rows), np.inf)
        for _ in range(min(pivots, len(rows))):
            picked.append(int(away.argmax()))
            away = np.minimum(away, ((rows - rows[picked[-1]]) ** 2).sum(axis=1))
        chosen[size] = rows[picked]
    return chosen


def _by_size(sample: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the sample for each dimension."""
    found: dict[int, tuple[list, list]] = {}
    for r in sample:
        ids, rows = found.setdefault(len(r["v"]), ([], []))
        ids.append(r["id"])
        rows.append(r["v"])
    return {n: (np.array(ids), np.array(rows, dtype=np.float64).reshape(len(rows), n)) for n, (ids, rows) in found.items()}


def _first_cells(table: dict[int, np.ndarray]) -> tuple[dict[int, int], int]:
    """The number of the first cell of each dimension, and of the cell of all others."""
    starts, following = {}, 0
    for size in sorted(table):
        starts[size] = following
        following += len(table[size])
    return starts, following


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _of_each_size(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, row numbers and vectors of the rows of one dimension."""
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = [flat[ends[r] - size : ends[r]] for r in at]
        yield size, at, np.concatenate(rows).reshape(len(at), size).astype(np.float64)


def _place(table: dict[int, np.ndarray]):
    """Task function: the cell of each vector, its distance from the pivot there, its squared length."""
    starts, other = _first_cells(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            cell, away, square = np.full(len(rows), other, dtype=np.int32), np.zeros(len(rows)), np.zeros(len(rows))
            for size, at, x in _of_each_size(rows.column("v")) if len(rows) else ():
                square[at] = (x**2).sum(axis=1)
                if size in starts:
                    far = _distances(x, table[size])
                    cell[at], away[at] = starts[size] + far.argmin(axis=1), far.min(axis=1)
            columns = [rows.column("id"), rows.column("v"), pa.array(cell), pa.array(away), pa.array(square)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "away", "square"])

    return run


def _visits(table: dict[int, np.ndarray], cells: list, first: dict[int, int], sample: dict, k: int):
    """Task function: a row for each shard a query has to ask in, with its floor."""
    starts, other = _first_cells(table)

    def floors(ids: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """The k-th best score of other ids in the sample; nothing is shown by fewer than k."""
        known, x = sample[size]
        scores, found = q @ x.T, np.full(len(q), -np.inf)
        for i in range(len(q)):
            usable = known != ids[i]
            own, mine = known[usable], scores[i][usable]
            order = np.argsort(-mine)
            _, best = np.unique(own[order], return_index=True)
            if len(best) >= k:
                found[i] = mine[order][np.sort(best)[k - 1]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            row, shard, floor = [], [], []
            for size, at, q in _of_each_size(rows.column("v")) if len(rows) else ():
                known = size in starts
                least = floors(ids[at], q, size) if known else np.full(len(at), -np.inf)
                own = (q**2).sum(axis=1)
                pivots = table.get(size, np.zeros((0, size)))
                far = _distances(q, pivots)
                for cell, parts, low, high, square in cells:
                    if not (starts[size] <= cell < starts[size] + len(pivots) if known else cell == other):
                        continue
                    going = np.arange(len(at))
                    if known:
                        to = far[:, cell - starts[size]]
                        gap = np.maximum(np.maximum(to - high, low - to), 0)
                        bound = np.minimum((own + square - gap**2) / 2, np.sqrt(own * square))
                        # As in the shards: rounding must not lower a bound.
                        going = np.flatnonzero(bound + 1 + (own + square) * 1e-9 >= least)
                    row.append(np.repeat(at[going], parts))
                    floor.append(np.repeat(least[going], parts))
                    shard.append(np.tile(first[cell] + np.arange(parts), len(going)))
            if not row:
                continue
            chosen = rows.take(pa.array(np.concatenate(row)))
            columns = [
                pa.array(np.concatenate(shard).astype(np.int64)), pa.array(np.full(len(chosen), True)),
                pa.array(np.concatenate(floor)), chosen.column("id"), chosen.column("v"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "asks", "floor", "id", "v"])

    return run


def _search(table: dict[int, np.ndarray], k: int, at_once: int = 128, step: int = 512):
    """Task function over shards, candidates before queries: the best of the shard per query."""

    def distances(x: np.ndarray, size: int) -> np.ndarray:
        return _distances(x, table.get(size, np.zeros((0, size))))

    def of_block(ids, x, square, to_pivots, query_ids, q, floors):
        own_square = (q**2).sum(axis=1)
        own = distances(q, q.shape[1])
        least = np.zeros((len(q), len(x)))
        for p in range(own.shape[1]):
            np.maximum(least, np.abs(own[:, p : p + 1] - to_pivots[None, :, p]), out=least)
        # Rounding of the distances must not lower a bound: 1 and a few units in the last places more.
        size = own_square[:, None] + square[None, :]
        bound = (size - least**2) / 2 + 1 + size * 1e-9
        best = []
        for i in range(len(q)):
            bounds = bound[i]
            able = np.flatnonzero((bounds >= floors[i]) & (ids != query_ids[i]))
            order = able[np.argsort(-bounds[able], kind="stable")]
            found_id, found = np.zeros(0, dtype=np.int64), np.zeros(0)
            at, taken = 0, step
            while at < len(order):
                some = order[at : at + taken]
                at, taken = at + taken, 2 * taken
                full = len(found) >= k
                if full and bounds[some[0]] < found[k - 1]:
                    break
                scores = x[some] @ q[i]
                if full:
                    some, scores = some[scores >= found[k - 1]], scores[scores >= found[k - 1]]
                found_id, found = np.concatenate((found_id, ids[some])), np.concatenate((found, scores))
                by = np.lexsort((found_id, -found))
                found_id, found = found_id[by], found[by]
                _, once_each = np.unique(found_id, return_index=True)
                keep = np.sort(once_each)[:k]
                found_id, found = found_id[keep], found[keep]
            best.append((np.full(len(found), query_ids[i]), found_id, found.astype(np.int64)))
        return [np.concatenate(c) for c in zip(*best)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, {}, {}
        for rows in batches:
            shard = rows.column("shard").to_numpy(zero_copy_only=False)
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            floors = rows.column("floor").to_numpy(zero_copy_only=False)
            v = rows.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and np.abs(flat).max() >= 1 << 31:
                raise ValueError("a component is beyond 2**31 after scaling")
            edge = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for i, j in zip(edge[:-1], edge[1:]):
                if shard[i] != current:
                    current, held, ready = shard[i], {}, {}
                for size in np.unique(sizes[i:j]).tolist():
                    at = i + np.flatnonzero(sizes[i:j] == size)
                    x = np.concatenate([flat[ends[r] - size : ends[r]] for r in at]).reshape(len(at), size).astype(np.float64)
                    if not asks[i]:
                        held.setdefault(size, []).append((ids[at], x))
                        continue
                    if size not in held:
                        continue
                    if size not in ready:
                        own = np.concatenate([a for a, _ in held[size]]), np.concatenate([b for _, b in held[size]])
                        ready[size] = *own, (own[1] ** 2).sum(axis=1), distances(own[1], size)
                    most = np.abs(ready[size][1]).max(initial=0) * np.abs(x).max(initial=0) * max(size, 1)
                    if most >= _EXACT:
                        raise ValueError("scores are too large to be exact")
                    for b in range(0, len(at), at_once):
                        some = at[b : b + at_once]
                        yield batch(_BEST, *of_block(*ready[size], ids[some], x[b : b + at_once], floors[some]))

    return run
