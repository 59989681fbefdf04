"""A manifest of a dataset as a Merkle tree, with a proof for every row by pointer jumping.

Rows are leaves. In every part, runs of ``arity`` nodes are hashed into one until one is left; the
parts' roots are the leaves of the tree above them. Every node then holds a segment: the siblings
it meets on its way to an ancestor, at first its parent. Joining the nodes with themselves on the
ancestor concatenates two segments and doubles the distance, so a tree of height h is done in
log2(h) joins. Only nodes that are ancestors of others are looked up, and their number falls by
``arity`` for every level.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.rows import dense_index
from tallybook.llm.common import others, prepare, quoted
from tallybook.sources.scratch import materialize

ARITY = 8
# Number of the tree above the parts, which are numbered from 0.
TOP = -1
_DIGEST = 32
_PATH = "array<struct<place:int,others:binary>>"
_RESULTS = ("leaf", "subroot", "root", "path")


class Manifest(NamedTuple):
    proofs: DataFrame  # the rows with leaf, subroot, root and path
    parts: DataFrame  # part, rows, subroot
    root: str | None  # of the whole dataset, None if it is empty


def digest_of(*fields: Column) -> Column:
    """SHA-256 as bytes over the fields: ``-`` for null, else UTF-8 length, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(digests: Column) -> Column:
    """Digest over the hex text of concatenated digests."""
    return F.unhex(F.sha2(hex_of(digests), 256))


def _joined(values: Column) -> Column:
    return F.aggregate(values, F.lit(b""), lambda done, x: F.concat(done, x))


def proof_of(path: Column) -> Column:
    """SHA-256 as hex over the siblings of a path, from the leaf up, each run from left to right."""
    return F.sha2(hex_of(_joined(F.transform(path, lambda x: x["others"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex, that a leaf's digest and its path lead to."""

    def up(below: Column, step: Column) -> Column:
        before = F.lit(_DIGEST) * step["place"]
        left = F.substr(step["others"], F.lit(1), before)
        right = F.substr(step["others"], before + F.lit(1), F.octet_length(step["others"]) - before)
        return _parent(F.concat(left, below, right))

    return hex_of(F.aggregate(path, leaf, up))


def manifest(leaves: DataFrame, part_col: str, order_col: str, leaf_col: str, arity: int = ARITY) -> Manifest:
    """Trees over ``leaves``, by ``order_col`` within each part, and every row's way to the root.

    ``leaf_col`` holds digests of 32 bytes. Rows whose ``order_col`` is null come first, equal ones
    go by digest, and each of repeated rows is a leaf. The null part is the first, the others
    follow by the bytes of their names. A run cut short is hashed as it is, even if it is one node;
    a part of one row has that leaf for a root, and so has a dataset of one part its part's. An
    empty dataset has no root. ``path`` has, for each level, the node's place in its run and the
    digests of the others; ``proof_of`` and ``folded`` use it. Other columns are kept unless a
    result has their name.
    """
    if arity < 2:
        raise ValueError(f"arity must be at least 2, got {arity}")
    prepare(leaves.sparkSession)
    kept = others(leaves, _RESULTS)
    rows = leaves.select(
        quoted(part_col).cast("string").alias("part"),
        quoted(order_col).alias("at"),
        quoted(leaf_col).alias("digest"),
        F.struct(F.lit(0).alias("_"), *[quoted(c).alias(f"_{c}") for c in kept]).alias("row"),
    )
    # Written first, so that sorting by ranges computes each digest once.
    order = [F.col(c).asc_nulls_first() for c in ("part", "at", "digest")]
    placed = dense_index(materialize(rows, "leaves"), order, "index")
    parts = _numbered_parts(placed, arity)
    count, tallest = parts.agg(F.count(F.lit(1)), F.coalesce(F.max("height"), F.lit(0))).first()
    top_height = sum(count > arity**k for k in range(64) if arity**k < 2**63)

    own = parts.select(F.col("part").alias("_part"), "tree", "first", "height")
    here = placed.join(own, F.col("part").eqNullSafe(F.col("_part"))).select(
        "tree", (F.col("index") - F.col("first")).alias("pos"), "digest", "height", "row"
    )
    runs, subroots = _grow(here, tallest, arity)
    subroots = materialize(subroots, "subroots")
    top = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(top_height).alias("height")
    )
    top_runs, roots = _grow(top, top_height, arity)
    found = roots.select(hex_of(F.col("digest")).alias("root")).first()

    # A row starts with its siblings and its parent; alone in its part, with its part's root and none.
    alone = here.where("height = 0").select(
        F.col("tree").alias("part_tree"),
        "digest",
        "row",
        F.lit(TOP).cast("long").alias("to_tree"),
        F.lit(0).alias("to_level"),
        F.col("tree").alias("to_pos"),
        F.array().cast(_PATH).alias("path"),
    )
    several = [
        _nodes(runs[0]).select(
            F.col("tree").alias("part_tree"), "kid.digest", "kid.row", "to_tree", "to_level", "to_pos", "path"
        )
    ] if runs else []
    rows = reduce(DataFrame.unionByName, [alone, *several])
    inner = [_nodes(r).select("tree", "level", "pos", "to_tree", "to_level", "to_pos", "path") for r in [*runs[1:], *top_runs]]
    distance, height = 1, max(tallest, 1) + top_height
    if inner:
        state = materialize(reduce(DataFrame.unionByName, inner), "segments")
        while distance < height:
            rows = _jump(rows, state, distance)
            if 2 * distance < height:
                state = materialize(_jump(state, state, distance), "segments")
            distance *= 2

    # Written, so that its size is known in the join and a part of most rows can be split between tasks.
    roots_of = materialize(
        parts.join(subroots, "tree").select(
            F.col("tree").alias("part_tree"), "part", "rows", hex_of(F.col("digest")).alias("subroot")
        ),
        "part-roots",
    )
    proofs = rows.join(roots_of.select("part_tree", "subroot"), "part_tree").select(
        *[F.col("row").getField(f"_{c}").alias(c) for c in kept],
        hex_of(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(found and found["root"]).cast("string").alias("root"),
        "path",
    )
    return Manifest(proofs, roots_of.select("part", "rows", "subroot"), found and found["root"])


def _numbered_parts(placed: DataFrame, arity: int) -> DataFrame:
    """Parts in order: number (``tree``), first index, rows and height."""
    counted = placed.groupBy("part").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("rows"))
    # Levels above the leaves: one for each power of the arity that the rows exceed.
    height = sum((F.col("rows") > F.lit(arity**k)).cast("int") for k in range(64) if arity**k < 2**63)
    return materialize(dense_index(counted, [F.col("first")], "tree").withColumn("height", height), "parts")


def _grow(nodes: DataFrame, tallest: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, written, and the root of every tree."""
    runs, done = [], []
    for level in range(tallest + 1):
        done.append(nodes.where(F.col("height") == level).select("tree", "digest"))
        if level == tallest:
            break
        kid = F.struct(*[c for c in ("pos", "digest", "row") if c in nodes.columns])
        by_place = F.array_sort(F.collect_list(kid), lambda a, b: F.signum(a["pos"] - b["pos"]).cast("int"))
        run = nodes.where(F.col("height") > level).groupBy("tree", F.expr(f"pos div {arity}").alias("up"), "height")
        run = run.agg(by_place.alias("kids")).select("*", F.lit(level).alias("level"))
        joined = _joined(F.transform("kids", lambda x: x["digest"]))
        runs.append(materialize(run.withColumn("joined", joined), f"runs-{level}"))
        nodes = runs[-1].select("tree", F.col("up").alias("pos"), _parent(F.col("joined")).alias("digest"), "height")
    return runs, reduce(DataFrame.unionByName, done)


def _nodes(run: DataFrame) -> DataFrame:
    """The nodes of one level, each with its siblings as a segment that leads to its parent."""
    node = run.select("*", F.posexplode("kids").alias("place", "kid"))
    before = F.lit(_DIGEST) * F.col("place")
    left = F.substr("joined", F.lit(1), before)
    right = F.substr("joined", before + F.lit(_DIGEST + 1), F.octet_length("joined"))
    step = F.struct(F.col("place"), F.concat(left, right).alias("others"))
    # The root of a part is known as a leaf of the tree above.
    root_next = (F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height"))
    return node.select(
        "tree",
        "level",
        F.col("kid.pos").alias("pos"),
        "kid",
        F.when(root_next, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("to_tree"),
        F.when(root_next, F.lit(0)).otherwise(F.col("level") + 1).alias("to_level"),
        F.when(root_next, F.col("tree")).otherwise(F.col("up")).alias("to_pos"),
        F.array(step).cast(_PATH).alias("path"),
    )


def _jump(rows: DataFrame, state: DataFrame, distance: int) -> DataFrame:
    """Rows with the segment of the ancestor they point to behind their own.

    An ancestor ``distance`` above a leaf is at least so high in its tree, which leaves few to look
    up. The root has no segment; rows that point to it stay as they are.
    """
    ancestors = state.where((F.col("tree") == TOP) | (F.col("level") >= distance)).select(
        F.col("tree").alias("to_tree"),
        F.col("level").alias("to_level"),
        F.col("pos").alias("to_pos"),
        F.struct("to_tree", "to_level", "to_pos").alias("_next"),
        F.col("path").alias("_path"),
    )
    met = rows.join(ancestors, ["to_tree", "to_level", "to_pos"], "left")
    kept = [c for c in rows.columns if c not in ("to_tree", "to_level", "to_pos", "path")]
    onward = [F.coalesce(F.col("_next").getField(c), F.col(c)).alias(c) for c in ("to_tree", "to_level", "to_pos")]
    return met.select(*kept, *onward, F.coalesce(F.concat("path", "_path"), F.col("path")).alias("path"))
