"""Document fingerprints: the ``k`` smallest hashes of a document's word shingles.

Sketches are ascending arrays of non-negative longs, so they can be stored, merged over parts and
compared with built-in array functions alone. The smallest hashes of a union are a sample of the
shingles of both sides; the share of it that both hold estimates the resemblance.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import carried, once, passed, passed_schema, prepare, quoted, restored, spread

RESULTS = ["sketch", "n_shingles"]

_STEP = 0x9E3779B97F4A7C15
_WORD = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 18
# Longs hold 63 bits of a hash without a sign.
_HASHES = 2.0**63


def fingerprint_documents(
    docs: DataFrame, k: int = 128, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns of ``docs`` with ``sketch`` and ``n_shingles``.

    ``sketch`` holds the ``k`` smallest distinct hashes of the ``shingle``-word shingles;
    ``n_shingles`` estimates how many distinct ones there are, exactly below ``k``. Words are split
    at ASCII white space, A-Z count as lower case; fewer words make one shingle, and null texts and
    texts without words none. Equal texts have equal sketches. Repeated rows each come out; input
    columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    texts = carried(docs, id_col, text_col, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = sketch_texts([(t.as_py() or "").encode() for t in rows.column("text")], k, shingle)
            yield passed(rows, True, sketch=pa.array(found, pa.list_(pa.int64())))

    schema = passed_schema(texts, True, "sketch array<long>")
    found = spread(texts, F.col("id"), F.col("text")).select("text", "rest").mapInArrow(run, schema)
    found = found.withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))
    return found.select(*restored(docs, text_col, RESULTS))


def merge_sketches(parts: DataFrame, keys: list[str], k: int, sketch: str = "sketch") -> DataFrame:
    """One sketch per key, over all its rows; null and empty sketches add nothing.

    Hashes are made distinct first and every task hands on at most ``k`` of a key, so a key that
    holds most rows meets no limit of a single task. Keys without any hash do not come out.
    """
    hashes = parts.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    smallest = hashes.withColumn("_place", place).where(F.col("_place") <= k)
    return smallest.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated share of the shingles of both that are common; 1 for two empty sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, too; 1 for an empty ``a``."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    common = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def distinct_shingles(sketch: Column, k: int) -> Column:
    """Estimated number of distinct shingles; the exact number below ``k``."""
    largest = (F.element_at(sketch, -1) + 1) / F.lit(_HASHES)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / largest)


def edited_fingerprints(
    docs: DataFrame,
    k: int = 128,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts_per_task: int = 4,
    sample_per_part: int = 32,
) -> DataFrame:
    """How sketches react to an edit: ``id``, ``n_chars``, ``edited_sha256``, ``sketch``,
    ``edited_sketch``, ``near_edited`` and ``near_next``.

    The edited text is a text whose last ``n_chars // 2`` code points are replaced by the first as
    many (or all) of the next document's; next is by ascending id, ties by a hash of the text, rows
    without an id behind all others, and behind the last row comes the first. ``near_edited`` and
    ``near_next`` are resemblances of a text to its edited text and to the next text. Null texts
    are empty.

    Documents are dealt out once, by ranges of ids from a sample of about ``sample_per_part`` rows
    for each part; the first document of a part also goes to the part before it.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(
        quoted(id_col).cast("long").alias("id"),
        F.coalesce(quoted(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"),
        F.xxhash64(quoted(text_col)).alias("h"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * parts_per_task
    keys = texts.select("d", "h")
    total, first = keys.agg(F.count(F.lit(1)), F.min(F.struct("d", "h"))).first()
    share = min(1.0, parts * sample_per_part / max(total, 1))
    sample = sorted({tuple(r) for r in keys.sample(False, share, 9).limit(2 * parts * sample_per_part).collect()})
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    start = tuple(first) if first else None
    places = F.explode(_places(bounds, start)("d", "h")).alias("place")
    dealt = (
        texts.select("*", places)
        .select("place.part", "place.kind", "d", "h", "id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "kind", "d", "h")
    )
    schema = (
        "id long, n_chars long, edited_sha256 string, sketch array<long>, edited_sketch array<long>, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(_edited(k, shingle), schema)


def _places(bounds: list[tuple], start: tuple | None):
    """The part a document belongs to, and the part that needs it behind its last document."""

    @F.pandas_udf("array<struct<part:int,kind:int>>")
    def places(d: pd.Series, h: pd.Series) -> pd.Series:
        found = []
        for key in zip(d.tolist(), h.tolist()):
            part = bisect_right(bounds, key)
            own = [{"part": part, "kind": 0}]
            if part and bounds[part - 1] == key and key != start:
                own.append({"part": part - 1, "kind": 1})
            if key == start:
                own.append({"part": len(bounds), "kind": 1})
            found.append(own)
        return pd.Series(found)

    return places


def _edited(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # The last document so far: part, id, text, sketch.
        ended = None  # The part whose last document has met its next one.
        for rows in batches:
            part, kind, ids = (rows.column(c).to_pylist() for c in ("part", "kind", "id"))
            texts = rows.column("text").to_pylist()
            sketches = sketch_texts([t.encode() for t in texts], k, shingle)
            pairs = []
            for p, extra, i, text, sketch in zip(part, kind, ids, texts, sketches):
                if held is not None and held[0] == p and ended != p:
                    pairs.append((held, text, sketch))
                if extra:
                    ended = p
                else:
                    held = (p, i, text, sketch)
            if not pairs:
                continue
            edited = []
            for (_, _, own, _), text, _ in pairs:
                cut = len(own) // 2
                edited.append((own[: len(own) - cut] + text[:cut]).encode())
            again = sketch_texts(edited, k, shingle)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([h[1] for h, _, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(h[2]) for h, _, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    "sketch": pa.array([h[3] for h, _, _ in pairs], pa.list_(pa.int64())),
                    "edited_sketch": pa.array(again, pa.list_(pa.int64())),
                    "near_edited": pa.array([_near(h[3], e, k) for (h, _, _), e in zip(pairs, again)], pa.float64()),
                    "near_next": pa.array([_near(h[3], s, k) for h, _, s in pairs], pa.float64()),
                }
            )

    return run


def _near(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Resemblance of two sketches, as ``resemblance`` has it."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    new = np.concatenate(([True], ~twice))
    size = min(k, int(new.sum()))
    last = both[np.flatnonzero(new)[size - 1]]
    return int((twice & (both[1:] <= last)).sum()) / size


def sketch_texts(texts: list[bytes], k: int, shingle: int) -> list[np.ndarray]:
    """The sketch of each text, chunks of texts at a time."""
    found: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < _CHUNK):
            size += len(texts[j]) + 1
            j += 1
        found.extend(_sketch_chunk(texts[i:j], k, shingle))
        i = j
    return found


def _tables(size: int):
    """Random words for bytes, 0 for white space; powers of the step and of its inverse."""
    words = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)
    words[65:91] = words[97:123]
    words[[9, 10, 11, 12, 13, 32]] = 0
    up = np.full(size, _STEP, dtype=np.uint64)
    down = np.full(size, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return words, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _sketch_chunk(texts: list[bytes], k: int, shingle: int) -> list[np.ndarray]:
    empty = np.zeros(0, dtype=np.int64)
    content = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    words, up, down = once("sketch_tables", lambda: _tables(_CHUNK + 1))
    if len(content) >= len(up):
        words, up, down = _tables(len(content) + 1)
    value = words[content]
    inside = value != 0
    if not inside.any():
        return [empty] * len(texts)
    sums = np.zeros(len(content) + 1, dtype=np.uint64)
    np.cumsum(value * up[: len(content)], out=sums[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate(([0], edge)) if inside[0] else edge
    begin, end = edge[::2], edge[1::2]
    word = _mixed((sums[end] - sums[begin]) * down[begin])
    stops = np.cumsum([len(t) + 1 for t in texts])
    of_word = np.searchsorted(stops, begin, side="right")
    number = np.bincount(of_word, minlength=len(texts))
    padded = np.concatenate((word, np.zeros(shingle, dtype=np.uint64)))
    owner = np.concatenate((of_word, np.full(shingle, -1)))
    hashes = np.zeros(len(word), dtype=np.uint64)
    for i in range(shingle):
        hashes *= _WORD
        same = owner[i : i + len(word)] == of_word
        hashes += np.where(same, padded[i : i + len(word)], 0).astype(np.uint64)
    hashes = (_mixed(hashes) >> np.uint64(1)).astype(np.int64)
    last = np.cumsum(number)
    found = []
    for n, stop in zip(number.tolist(), last.tolist()):
        own = np.sort(hashes[stop - n : stop - n + max(n - shingle + 1, min(n, 1))])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        found.append(own[:k].copy())
    return found
