"""Near-duplicates by Jaccard likeness of word shingles: an exact join by a partitioned universe.

Two sets that are alike enough differ in at most ``H`` shingles, ``H`` growing with their size. So
sets fall into bands of size, each with a scheme that hashes the universe of shingles into
``H + 1`` segments. The part of a set in a segment is its subset there. If every segment ``i`` is
given a number ``t[i]`` of -1, 0 or 1 and the ``t[i] + 1`` sum to ``H + 1``, two alike sets differ
by ``t[i]`` shingles or less in one segment at least: equal subsets (0), or subsets equal but for
one shingle (1), found through the keys of a subset with each one of its shingles left out. Which
segments get 1 in return for others that get -1 is decided by the candidates a sample shows them to
bring and by the keys they cost. Every segment at 0 is the allocation to start from.

Sets that share a key are candidates. All that met the same smallest set at a key are one group,
which holds every candidate pair of that key. Groups are verified exactly, in parts of a bounded
size: within each part, then, of large groups, the sets not yet in one component with the smallest
against the other parts. Pairs already in one component are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallybook.llm.common import batch, once, prepare, quoted, spread
from tallybook.llm.simhash_dedup import connected
from tallybook.sources.scratch import materialize

# Width of a band, in steps of the largest ratio of sizes that can still be alike.
BAND_STEPS = 3
# Schemes with more segments keep all of them at 0.
ALLOCATED_SEGMENTS = 4096
# Shingles of one part of a group that is verified at once.
BLOCK_SHINGLES = 1 << 17
# Weight of a candidate against that of a key.
CANDIDATE_COST = 4.0
# Share of the sampled sets that makes a key a hot one.
HOT_SHARE = 0.01

_PRINTS = pa.schema(
    [(n, pa.int64()) for n in ("id", "h", "d1", "d2", "n")] + [("keys", pa.list_(pa.int64()))]
)
_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
_TRIED = pa.schema([("scheme", pa.int32()), ("segment", pa.int32()), ("whole", pa.bool_()), ("key", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_GOLD, _SECOND, _THIRD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_HIGH = np.uint64(32)


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    percent: int = 90,
    sample: int = 4096,
    block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document: ``id``, ``n_shingles`` and ``component_id``.

    Words are split at ASCII white space and A-Z lower-cased. A document's set holds its distinct
    shingles of ``shingle`` words; fewer words are one shingle, no words (or a null text) an empty
    set, which is linked with nothing. Two documents are linked if a hundred times the size of the
    intersection reaches ``percent`` times that of the union. ``component_id`` is the smallest id
    reachable over links, the document's own included; null if none there has an id. Repeated
    rows each come out. Shingles are told apart by 64 bits, sets by 128.

    ``sample`` bounds the documents the allocation and the hot keys are read from; they decide
    what a search costs, never what it finds. ``block`` bounds the shingles held at once.
    """
    if not 0 < percent <= 100 or shingle < 1:
        raise ValueError(f"percent must be 1 to 100 and shingle positive, got {percent} and {shingle}")
    prepare(docs.sparkSession)
    texts = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.xxhash64(quoted(text_col)).alias("h"),
        quoted(text_col).cast("string").alias("text"),
    )
    share = min(1.0, sample / max(texts.count(), 1))
    sampled = materialize(texts.select("text").sample(False, share, 11), "sample")
    allocation = _allocation(sampled, shingle, percent, share)
    fields = "id long, h long, d1 long, d2 long, n long, keys array<long>"
    # Texts are read in place; only an input in fewer splits than there are cores is dealt out.
    cores = docs.sparkSession.sparkContext.defaultParallelism
    dealt = texts if texts.rdd.getNumPartitions() >= cores else spread(texts, F.col("id"), F.col("h"))
    prints = materialize(dealt.mapInArrow(_print(shingle, percent, allocation), fields), "prints")
    hot = _hot_keys(sampled, shingle, percent, allocation)
    classes = _classes(prints)
    met = _met(prints, classes, hot)
    roots = _linked(texts, classes, met, shingle, percent, block)
    return _with_components(prints, classes, roots)


def _classes(prints: DataFrame) -> DataFrame:
    """One row per distinct set: ``node``, its digest, size, smallest id, and a document that holds it."""
    who = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("who")
    rows = prints.where("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.min("id").alias("first"), who)
    rows = rows.select("d1", "d2", "n", "first", "who.id", "who.h", F.monotonically_increasing_id().alias("node"))
    return materialize(rows, "sets")


def _hot_keys(sampled: DataFrame, shingle: int, percent: int, allocation: dict[int, bytes]) -> DataFrame:
    """Keys of a stated share of the sampled documents; at most its inverse times their average keys."""
    fields = "id long, h long, d1 long, d2 long, n long, keys array<long>"
    blank = sampled.select(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("h"), "text")
    found = blank.mapInArrow(_print(shingle, percent, allocation, repeats=True), fields)
    least = max(8, math.ceil(HOT_SHARE * sampled.count()))
    keys = found.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= least)
    return materialize(keys.select("key"), "hot")


def _met(prints: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """(rep, node): each set with the smallest of the sets that share one of its keys.

    The few hot keys get their smallest set by an aggregate that shrinks before it is shuffled and
    are looked up; the rows of all others meet at their key.
    """
    keys = prints.where(F.size("keys") > 0).select("d1", F.explode("keys").alias("key"))
    few = materialize(keys.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("d1").alias("rep")), "hot-sets")
    marked = keys.join(F.broadcast(few), "key", "left")
    known = marked.where(F.col("rep").isNotNull()).select("rep", "d1")
    rest = marked.where(F.col("rep").isNull()).select("key", "d1")
    of_key = F.min("d1").over(Window.partitionBy("key"))
    pairs = known.unionByName(rest.select(of_key.alias("rep"), "d1")).where("rep <> d1").distinct()
    node = classes.select("d1", "node", "n")
    named = materialize(pairs, "met").join(node, "d1").drop("d1").withColumnRenamed("rep", "d1")
    smallest = node.select("d1", F.col("node").alias("rep"))
    return materialize(named.join(smallest, "d1").select("rep", "node", "n"), "met")


def _linked(
    texts: DataFrame, classes: DataFrame, met: DataFrame, shingle: int, percent: int, block: int
) -> DataFrame:
    """``node`` and ``root`` of every set linked to a smaller node, over all links."""
    wanted = met.select("node").unionByName(met.select(F.col("rep").alias("node"))).distinct()
    holders = materialize(classes.join(wanted, "node", "left_semi").select("node", "d1", "d2", "id", "h"), "holders")
    holders = holders.withColumnsRenamed({"id": "_id", "h": "_h"})
    same = (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))
    own = texts.hint("merge").join(holders, same).select("node", "d1", "d2", "text")
    sets = materialize(own.mapInArrow(_shingles_of(shingle), "node long, shingles binary"), "shingles")

    # Every group, the sets that met one smallest set, in parts of a bounded size.
    sizes = met.groupBy("rep").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts"))
    sizes = materialize(sizes, "groups")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    members = materialize(met.join(sizes, "rep").select("rep", part, "node", "parts"), "members")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    visits = members.select("rep", "part", "node").unionByName(sizes.select("rep", every, F.col("rep").alias("node")))
    links = materialize(_dealt(visits, sets).mapInArrow(_resolve(percent), "a long, b long"), "verified")
    roots = connected(links)

    # What is left are pairs of different parts, of which one is not yet with the smallest set.
    several = members.where("parts > 1")
    label = lambda name: F.coalesce(F.col("root"), F.col(name))
    labelled = several.join(roots, "node", "left").select("rep", "part", "node", "parts", label("node").alias("part_of"))
    of_rep = roots.select(F.col("node").alias("rep"), "root")
    labelled = materialize(
        labelled.join(of_rep, "rep", "left").select(
            "rep", "part", "node", "parts", "part_of", (F.col("part_of") != label("rep")).alias("apart")
        ),
        "labelled",
    )
    open_groups = labelled.groupBy("rep").agg(F.max("apart").alias("open")).where("open").select("rep")
    left = labelled.join(materialize(open_groups, "open"), "rep")
    at_home = left.select("rep", "part", F.lit(False).alias("asks"), "node", "part_of")
    asking = left.where("apart").select("rep", every, F.lit(True).alias("asks"), "node", "part_of")
    more = _dealt(at_home.unionByName(asking), sets, "asks").mapInArrow(_ask(percent), "a long, b long")
    return connected(links.unionByName(more))


def _dealt(visits: DataFrame, sets: DataFrame, *order: str) -> DataFrame:
    """Visits with their sets, those of one part of a group next to each other."""
    met = visits.hint("merge").join(sets, "node")
    return met.repartition("rep", "part").sortWithinPartitions("rep", "part", *order)


def _with_components(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    grouped = classes.join(roots, "node", "left").select("d1", "d2", "first", F.coalesce("root", "node").alias("root"))
    smallest = materialize(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = materialize(grouped.join(smallest, "root").select("d1", "d2", "component_id"), "named")
    return prints.drop("h", "keys").join(named, ["d1", "d2"], "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


# Sets and schemes.


class _Words(dict):
    """Hashes of the words seen, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def shingle_set(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array([words[w] for w in found], dtype=np.uint64)
    width = min(size, len(hashes))
    count = len(hashes) - width + 1
    mixed = np.full(count, width, dtype=np.uint64) * _SECOND
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + count]) * _GOLD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _THIRD
        mixed ^= mixed >> _HIGH
    return np.unique(mixed)


def _ratio(percent: int) -> float:
    return max((100 / percent) ** BAND_STEPS, 1.1)


def bands(percent: int, largest: int) -> np.ndarray:
    """First size of every band, up to one past ``largest``."""
    first = [1]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, math.ceil(first[-1] * _ratio(percent))))
    return np.array(first, dtype=np.int64)


def segments(percent: int, band: int, first: np.ndarray) -> int:
    """Segments of a band's scheme: one more than two alike sets of it can differ in."""
    return 2 * (int(first[band + 1]) - 1) * (100 - percent) // (100 + percent) + 1


def schemes_of(size: int, percent: int, first: np.ndarray) -> list[int]:
    """The scheme of a set's own band, and the next one if sets of that band can be alike."""
    band = int(np.searchsorted(first, size, side="right")) - 1
    return [band, band + 1] if size * 100 >= percent * int(first[band + 1]) else [band]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _SECOND
    return values ^ (values >> np.uint64(31))


def subset_keys(shingles: np.ndarray, count: int, scheme: int, one: np.ndarray | None):
    """Segment and key of the whole subsets, and of those with one shingle left out where ``one``.

    ``shingles`` are sorted, so a segment is a run of them; a subset's content is a sum, from which
    leaving a shingle out is a subtraction.
    """
    segment = ((shingles >> _HIGH) * np.uint64(count) >> _HIGH).astype(np.int64)
    own = _mixed(shingles ^ _GOLD)
    edge = np.searchsorted(segment, np.arange(count + 1))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(own, dtype=np.uint64)))
    content = total[edge[1:]] - total[edge[:-1]]
    salt = _mixed((np.uint64(scheme) << _HIGH) + np.arange(count, dtype=np.uint64) + np.uint64(1))
    whole = _mixed((content + _THIRD) * _GOLD ^ salt)
    if one is None:
        return whole, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(one[segment])
    less = content[segment[at]] - own[at]
    return whole, segment[at], _mixed((less + _THIRD) * _GOLD ^ salt[segment[at]])


def _keys(shingles: np.ndarray, percent: int, first: np.ndarray, allocation: dict[int, bytes]) -> np.ndarray:
    found = []
    for scheme in schemes_of(len(shingles), percent, first):
        count = segments(percent, scheme, first)
        given = allocation.get(scheme)
        if given is None:
            found.append(subset_keys(shingles, count, scheme, None)[0])
            continue
        given = np.frombuffer(given, dtype=np.int8)
        whole, _, less = subset_keys(shingles, count, scheme, given == 1)
        found += [whole[given >= 0], less]
    return np.unique(np.concatenate(found))


def _allocation(sampled: DataFrame, shingle: int, percent: int, share: float) -> dict[int, bytes]:
    """For the schemes where it pays, a number of -1, 0 or 1 for every segment.

    The cost of a segment at 0 or 1 is what the sample, scaled up, shows of keys and candidate
    pairs. Segments at 1 pay for as many at -1, as long as a swap saves something. What comes to
    the driver is a row for each segment of the schemes with at most ``ALLOCATED_SEGMENTS``.
    """
    tried = sampled.mapInArrow(_try(shingle, percent), "scheme int, segment int, whole boolean, key long")
    counts = tried.groupBy("scheme", "segment", "key").agg(
        F.count(F.lit(1)).alias("f"), F.sum(F.col("whole").cast("long")).alias("w")
    )
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    rows = counts.groupBy("scheme", "segment").agg(
        F.sum("w").alias("keys0"), F.sum("f").alias("keys1"), pairs("w").alias("pairs0"), pairs("f").alias("pairs1")
    )
    found: dict[int, list] = {}
    for r in rows.collect():
        cost = [k / share + CANDIDATE_COST * p / share**2 for k, p in ((r.keys0, r.pairs0), (r.keys1, r.pairs1))]
        found.setdefault(r.scheme, []).append((r.segment, *cost))
    chosen = {}
    for scheme, costs in found.items():
        count = segments(percent, scheme, bands(percent, 1 << 40))
        at0, at1 = np.zeros(count), np.full(count, np.inf)
        for segment, cost0, cost1 in costs:
            at0[segment], at1[segment] = cost0, cost1
        given = swapped(at0, at1)
        if given.any():
            chosen[scheme] = given.tobytes()
    return chosen


def swapped(at0: np.ndarray, at1: np.ndarray) -> np.ndarray:
    """Numbers of the segments: dearest ones dropped for as many that are raised cheaply."""
    given = np.zeros(len(at0), dtype=np.int8)
    dropped, raised = np.argsort(-at0, kind="stable"), np.argsort(at1 - at0, kind="stable")
    i = j = 0
    while i < len(dropped) and j < len(raised):
        drop, up = dropped[i], raised[j]
        if given[drop]:
            i += 1
        elif given[up] or up == drop:
            j += 1
        elif at0[drop] > at1[up] - at0[up]:
            given[drop], given[up] = -1, 1
        else:
            break
    return given


# Task functions.


def _try(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once("shingle_words", _Words)
        first = bands(percent, 1 << 40)
        for rows in batches:
            for text in rows.column("text"):
                shingles = shingle_set(text.as_py(), shingle, words)
                for scheme in schemes_of(len(shingles), percent, first) if len(shingles) else ():
                    count = segments(percent, scheme, first)
                    if count > ALLOCATED_SEGMENTS:
                        continue
                    whole, at, less = subset_keys(shingles, count, scheme, np.ones(count, dtype=bool))
                    segment = np.concatenate((np.arange(count), at))
                    keys = np.concatenate((whole, less)).view(np.int64)
                    yield batch(
                        _TRIED, np.full(len(keys), scheme), segment.astype(np.int32), np.arange(len(keys)) < count, keys
                    )

    return run


def _print(shingle: int, percent: int, allocation: dict[int, bytes], repeats: bool = False):
    """Digest, size and keys of each document; of equal sets in a task only one has keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once("shingle_words", _Words)
        first = bands(percent, 1 << 40)
        seen: set[bytes] = set()
        for rows in batches:
            digests, sizes, keys, ends = [], [], [], [0]
            for text in rows.column("text"):
                shingles = shingle_set(text.as_py(), shingle, words)
                digest = xxhash.xxh3_128_digest(shingles.tobytes(), 3)
                digests.append(digest)
                sizes.append(len(shingles))
                if len(shingles) and (repeats or digest not in seen):
                    keys.append(_keys(shingles, percent, first, allocation))
                    ends.append(ends[-1] + len(keys[-1]))
                    if not repeats:
                        seen.add(digest)
                else:
                    ends.append(ends[-1])
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))
            yield batch(
                _PRINTS, rows.column("id"), rows.column("h"), halves[:, 0].copy(), halves[:, 1].copy(), sizes, lists
            )

    return run


def _shingles_of(shingle: int):
    """Sets of the documents that hold the wanted ones; each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once("shingle_words", _Words)
        seen: set[int] = set()
        for rows in batches:
            nodes, sets = [], []
            for node, d1, d2, text in zip(*(rows.column(c) for c in ("node", "d1", "d2", "text"))):
                if node.as_py() in seen:
                    continue
                own = shingle_set(text.as_py(), shingle, words).tobytes()
                halves = np.frombuffer(xxhash.xxh3_128_digest(own, 3), dtype=np.int64)
                if halves[0] == d1.as_py() and halves[1] == d2.as_py():
                    seen.add(node.as_py())
                    nodes.append(node.as_py())
                    sets.append(own)
            yield batch(_SETS, nodes, sets)

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact check, on sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def _cells(shingles: np.ndarray, count: int) -> np.ndarray:
    """A byte for each of ``count`` cells of the universe; sets differ in no fewer shingles than cells."""
    cell = ((shingles >> _HIGH) * np.uint64(count) >> _HIGH).astype(np.int64)
    edge = np.searchsorted(cell, np.arange(count + 1))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mixed(shingles), dtype=np.uint64)))
    return (_mixed(total[edge[1:]] - total[edge[:-1]]) >> np.uint64(56)).astype(np.uint8)


class _Group:
    """Sets at home in one part of a group, with the components they are known to be in."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], labels: list[int]):
        self.nodes, self.sets, self.labels = np.array(nodes), sets, np.array(labels)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        count = int(min(max(64, self.sizes.mean() // 2), 4096))
        self.cells = np.stack([_cells(s, count) for s in sets])

    def links(self, own: np.ndarray, label: int, percent: int, at_once: int = 4096) -> list[int]:
        """Places of sets alike to one of component ``label``, one of each other component."""
        mine = _cells(own, self.cells.shape[1])
        both = self.sizes + len(own)
        # Alike sets share at least this many, so differ in no more than the rest.
        most = both - 2 * (-(-percent * both // (100 + percent)))
        found, places = {label}, []
        for i in range(0, len(self.sets), at_once):
            some = slice(i, i + at_once)
            close = (self.labels[some] != label) & (np.abs(self.sizes[some] - len(own)) <= most[some])
            close[close] &= (self.cells[some][close] != mine).sum(axis=1) <= most[some][close]
            for k in np.flatnonzero(close) + i:
                if self.labels[k] not in found and alike(own, self.sets[k], percent):
                    found.add(self.labels[k])
                    places.append(int(k))
        return places


def _resolve(percent: int):
    """Task function over the visits of each part of a group: links that connect what is alike in it."""

    def links_of(rep: int, members: dict[int, np.ndarray]) -> tuple[list[int], list[int]]:
        first = members.pop(rep)
        a, b = [], []
        with_first = [alike(first, own, percent) for own in members.values()]
        for node, linked in zip(members, with_first):
            if linked:
                a.append(rep)
                b.append(node)
        if len(members) > 1 and not all(with_first):
            nodes, sets = list(members), list(members.values())
            group = _Group(nodes, sets, [-1 if linked else i for i, linked in enumerate(with_first)])
            for i in np.flatnonzero(~np.array(with_first)):
                for k in group.links(sets[i], group.labels[i], percent):
                    a.append(nodes[i])
                    b.append(nodes[k])
                    group.labels[group.labels == group.labels[k]] = group.labels[i]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, {}
        for rows in batches:
            rep, part, node = (rows.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("rep", "part", "node"))
            sets = rows.column("shingles")
            a, b = [], []
            for i in range(rows.num_rows):
                if (rep[i], part[i]) != current:
                    if members:
                        more = links_of(current[0], members)
                        a, b = a + more[0], b + more[1]
                    current, members = (rep[i], part[i]), {}
                members[node[i]] = _as_set(sets[i]).copy()
            yield batch(_LINKS, a, b)
        if members:
            yield batch(_LINKS, *links_of(current[0], members))

    return run


def _ask(percent: int):
    """Task function over the visits of each part of a group: links of the asking sets to those at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at_home, group = None, [], None
        for rows in batches:
            rep, part, node, part_of = (
                rows.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("rep", "part", "node", "part_of")
            )
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            sets = rows.column("shingles")
            a, b = [], []
            for i in range(rows.num_rows):
                if (rep[i], part[i]) != current:
                    current, at_home, group = (rep[i], part[i]), [], None
                if not asks[i]:
                    at_home.append((node[i], _as_set(sets[i]).copy(), part_of[i]))
                elif at_home:
                    group = group or _Group(*map(list, zip(*at_home)))
                    found = group.links(_as_set(sets[i]), part_of[i], percent)
                    a += [node[i]] * len(found)
                    b += group.nodes[found].tolist()
            yield batch(_LINKS, a, b)

    return run
