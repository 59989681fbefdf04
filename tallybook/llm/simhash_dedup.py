"""Near-duplicates by SimHash: fingerprints, a forest of vantage-point trees, linked groups.

Two fingerprints at most ``bits`` apart differ by at most ``bits // bands`` in one of ``bands``
parts of their 64 bits. Each part has a vantage-point tree over the Hamming distance within it: a
node keeps a vantage point and a radius, fingerprints within the radius go inside and the others
outside. A fingerprint lives in one leaf and asks in every leaf that the triangle inequality
leaves open, so shards overlap at their boundaries only and all pairs are found exactly.

The trees that deal fingerprints out have at most 2 ** 14 leaves each, so what the driver and every
task hold of them is bounded. A task that meets more fingerprints in a leaf than it was planned for
grows the tree on below it, over the fingerprints of that leaf alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import batch, prepare, quoted, spread
from tallybook.sources.scratch import materialize

_PRINTS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])
_VISITS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("asks", pa.bool_()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    bits: int = 4,
    bands: int = 3,
    leaf: int = 1024,
    block: int = 1 << 15,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``h`` (hash of its text), ``row``, ``fp``, ``root`` and ``component_id``.

    Words are split at ASCII white space and A-Z lower-cased; a bit of ``fp`` (64 bits as a long)
    is 1 if more than half of the XXH64 values (seed 42) of the ``shingle``-word shingles, repeats
    included, have it. Fewer words make one shingle; texts without words, and null ones, have
    fingerprint 0 and are linked like any other. Documents are linked at ``bits`` or fewer
    differing bits; ``component_id`` is the smallest id reachable over links, null if no document
    of the group has an id. ``root``, the smallest fingerprint reachable, tells such groups apart.
    ``row`` is the long in ``row_col``, null without one. Repeated rows each come out.

    ``leaf`` is the number of fingerprints a leaf is planned for; a task cuts larger ones further.
    A leaf with more than ``block`` of them is searched in several parts by tasks of their own.
    """
    prepare(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, row_col), "prints")
    return _with_components(prints, linked(prints.select("fp"), bits, bands, leaf, block))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, row_col: str | None = None
) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``row`` and ``fp`` of every document."""
    texts = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.xxhash64(quoted(text_col)).alias("h"),
        (quoted(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
        quoted(text_col).cast("string").alias("text"),
    )
    return spread(texts, F.col("id"), F.col("h")).mapInArrow(_fingerprint(shingle), "id long, h long, row long, fp long")


def one_of_each(groups: DataFrame) -> DataFrame:
    """Keys ``id``, ``h`` and ``row`` of the one row of each group that stays: the smallest.

    A row without an id stays only if its whole group has none. Rows equal in id and text differ in
    ``row`` alone, so only with it do the keys name a single row.
    """
    smallest = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "row")).alias("first")
    return groups.groupBy("root").agg(smallest).select("first.id", "first.h", "first.row")


def linked(prints: DataFrame, bits: int, bands: int, leaf: int, block: int) -> DataFrame:
    """``node`` and ``root`` for every fingerprint linked to a smaller one, over all links."""
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    forest = _plant(nodes, bits, bands, leaf)
    homes = nodes.mapInArrow(_visit(forest, {}, homes_only=True), "shard int, part int, asks boolean, fp long")
    sizes = homes.groupBy("shard").count().where(F.col("count") > block).collect()
    parts = {r["shard"]: -(-r["count"] // block) for r in sizes}
    visits = nodes.mapInArrow(_visit(forest, parts, homes_only=False), "shard int, part int, asks boolean, fp long")
    dealt = visits.repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")
    links = dealt.mapInArrow(_link(bits, forest, leaf), "a long, b long")
    return connected(links)


def connected(links: DataFrame) -> DataFrame:
    """Each node of an undirected graph with the smallest node it is connected to, if that is another.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then every node hands its smaller neighbours to the smallest of them.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = _handed(both, F.least(F.min("b"), F.col("a")), F.col("b") > F.col("a"))
        handed = _handed(edges, F.min("b"), F.lit(True))
        own = edges.groupBy("a").agg(F.min("b").alias("b"))
        edges = materialize(handed.unionByName(own).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _handed(edges: DataFrame, smallest: Column, which: Column) -> DataFrame:
    """Neighbours ``b`` of each ``a`` linked to the smallest instead.

    The minima are written first: read anew, they are exchanged by themselves, so that a node with
    most links can be split between tasks in the join.
    """
    minima = materialize(edges.groupBy("a").agg(smallest.alias("m")), "minima")
    found = edges.join(minima, "a").where(which).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return found.where("a <> b").distinct()


def _with_components(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Every document with the smallest fingerprint and the smallest id of its group."""
    first = prints.groupBy("fp").agg(F.min("id").alias("id"))
    grouped = first.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    # Written by themselves, so that a group with most fingerprints can be split between tasks in the join.
    smallest = materialize(grouped.groupBy("root").agg(F.min("id").alias("component_id")), "smallest")
    named = materialize(grouped.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"), "groups")
    return prints.join(named, "fp").select("id", "h", "row", "fp", "root", "component_id")


def _fingerprint(shingle: int):
    def of_text(text: bytes) -> bytes:
        words = text.lower().split()
        if not words:
            return b"\0" * 8
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        count = max(len(words) - shingle + 1, 1)
        begin = np.concatenate(([0], gaps + 1))[:count].tolist()
        end = np.concatenate((gaps, [len(joined)]))[-count:].tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(begin, end)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        return np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > count).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = b"".join([of_text((t.as_py() or "").encode()) for t in rows.column("text")])
            fp = np.frombuffer(found, dtype=">u8").astype(np.uint64).view(np.int64)
            yield batch(_PRINTS, rows.column("id"), rows.column("h"), rows.column("row"), fp)

    return run


def _plant(nodes: DataFrame, bits: int, bands: int, leaf: int, max_depth: int = 14, per_leaf: int = 16):
    """Vantage points and radii of one tree for each band, from a sample of the fingerprints.

    The sample has about ``per_leaf`` fingerprints for each of at most ``2 ** max_depth`` leaves.
    It decides how evenly shards are filled, never what is found.
    """
    count = nodes.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(max(count, 1) / leaf))))
    share = min(1.0, per_leaf * 2**depth / max(count, 1))
    rows = nodes.sample(False, share, 7).collect() if depth else []
    sample = np.sort(np.array([r["fp"] for r in rows], dtype=np.int64)).view(np.uint64)
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]
    rng = np.random.default_rng(7)
    trees = []
    for mask in masks:
        point = np.zeros(max(2**depth - 1, 1), dtype=np.uint64)
        radius = np.full(len(point), 64, dtype=np.int64)
        held = [sample]
        for node in range(2**depth - 1):
            own = held[node]
            inside = outside = own[:0]
            if len(own):
                tried = rng.choice(own, min(8, len(own)), replace=False)
                away = np.bitwise_count((own[None, :] ^ tried[:, None]) & mask).astype(np.int64)
                chosen = int(away.std(axis=1).argmax())
                point[node], radius[node] = tried[chosen], int(np.median(away[chosen]))
                inside, outside = own[away[chosen] <= radius[node]], own[away[chosen] > radius[node]]
            held += [inside, outside]
        trees.append((mask, point, radius))
    return depth, bits // bands, trees


def _visit(forest, parts: dict[int, int], homes_only: bool):
    """Task function: the leaf each fingerprint lives in, and those it has to ask in."""
    depth, reach, trees = forest

    def leaves(fp: np.ndarray, slack: int, tree: int):
        mask, point, radius = trees[tree]
        at, node = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
        for _ in range(depth):
            away = np.bitwise_count((fp[at] ^ point[node]) & mask).astype(np.int64) - radius[node]
            inside, outside = away <= slack, away > -slack
            at, node = np.concatenate((at[inside], at[outside])), np.concatenate((2 * node[inside] + 1, 2 * node[outside] + 2))
        return at, node - (2**depth - 1) + tree * 2**depth

    counts = np.ones(len(trees) * 2**depth, dtype=np.int64)
    counts[list(parts)] = list(parts.values())

    def split(shard: np.ndarray, fp: np.ndarray, asks: bool):
        count = counts[shard]
        if not asks:
            return shard, fp, (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % count
        part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(shard, count), np.repeat(fp, count), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fp = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in range(len(trees)):
                for asks in (False,) if homes_only else (False, True):
                    at, shard = leaves(fp, reach if asks else 0, tree)
                    shard, own, part = split(shard, fp[at], asks)
                    yield batch(_VISITS, shard.astype(np.int32), part.astype(np.int32), np.full(len(own), asks), own.view(np.int64))

    return run


def _grown(own: np.ndarray, mask: np.uint64, leaf: int):
    """A tree below one shard: ``(point, radius, inside, outside)`` at nodes, places in ``own`` at leaves.

    Fingerprints equal under ``mask`` cannot be told apart and stay in one leaf however many they are.
    """
    rng = np.random.default_rng(7)

    def grow(places: np.ndarray):
        if len(places) <= leaf:
            return places
        some = own[rng.choice(places, min(256, len(places)), replace=False)]
        spread_of = np.bitwise_count((some[None, :] ^ some[:8, None]) & mask).astype(np.int64).std(axis=1)
        point = some[int(spread_of.argmax())]
        away = np.bitwise_count((own[places] ^ point) & mask).astype(np.int64)
        radius = min(int(np.median(away)), int(away.max()) - 1)
        if radius < 0:
            return places
        return point, radius, grow(places[away <= radius]), grow(places[away > radius])

    return grow(np.arange(len(own)))


def _reached(tree, asking: np.ndarray, mask: np.uint64, reach: int):
    """Leaves of a grown tree, each with the places in ``asking`` of those that have to ask there."""
    open_ = [(tree, np.arange(len(asking)))]
    while open_:
        node, at = open_.pop()
        if len(at) == 0:
            continue
        if isinstance(node, np.ndarray):
            yield node, at
            continue
        point, radius, inside, outside = node
        away = np.bitwise_count((asking[at] ^ point) & mask).astype(np.int64) - radius
        open_ += [(inside, at[away <= reach]), (outside, at[away > -reach])]


def _link(bits: int, forest, leaf: int, compared_at_once: int = 1 << 21):
    """Task function over the visits of each shard: links that connect what is close there.

    Fingerprints of a leaf that one asking fingerprint is close to are connected by one link
    each, so a dense shard gives a spanning forest, not all its pairs.
    """
    depth, reach, trees = forest
    masks = [mask for mask, _, _ in trees]

    def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in np.unique(np.stack((a, b)), axis=1).T:
            x, y = top(x), top(y)
            root[max(x, y)] = min(x, y)

    def compared(places: np.ndarray, asking: np.ndarray, homes: np.ndarray, root: np.ndarray):
        """Links of ``asking`` with the homes at ``places``; homes close to the same one are merged."""
        near = homes[places]
        step = max(1, compared_at_once // len(near))
        for k in range(0, len(asking), step):
            some = asking[k : k + step]
            q, x = np.nonzero(np.bitwise_count(some[:, None] ^ near[None, :]) <= bits)
            apart = some[q] != near[x]
            if not apart.any():
                continue
            first = np.full(len(some), -1, dtype=np.int64)
            first[q[::-1]] = x[::-1]
            linking = np.unique(q[apart])
            yield batch(_LINKS, some[linking].view(np.int64), near[first[linking]].view(np.int64))
            several = x != first[q]
            if several.any():
                merged(root, places[x[several]], places[first[q[several]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, homes, root, tree = None, [], None, None

        def closed():
            if root is not None:
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    yield batch(_LINKS, homes[moved].view(np.int64), homes[root[moved]].view(np.int64))

        for rows in batches:
            shard, part = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "part"))
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            fp = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            group = shard << 32 | part
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for i, j in zip(edge[:-1], edge[1:]):
                if group[i] != current:
                    yield from closed()
                    current, homes, root = group[i], np.zeros(0, dtype=np.uint64), None
                own, asking = fp[i:j][~asks[i:j]], fp[i:j][asks[i:j]]
                if len(own):
                    homes = np.concatenate((homes, own))
                if len(homes) == 0 or len(asking) == 0:
                    continue
                mask = masks[int(shard[i]) >> depth]
                if root is None:
                    root, tree = np.arange(len(homes)), _grown(homes, mask, leaf)
                for places, at in _reached(tree, asking, mask, reach):
                    yield from compared(places, asking[at], homes, root)
        yield from closed()

    return run
