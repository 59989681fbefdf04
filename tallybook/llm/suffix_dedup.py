"""Removing repeated byte strings of a corpus with suffix arrays over shards.

A string of ``length`` bytes that occurs twice contains, at the same place, the ``anchor`` bytes
whose hash is smallest in it. Every window of ``length`` bytes is given to that anchor, and the
windows of one anchor in one document follow each other, so a corpus is cut into short pieces
that can only share a window if they share their anchor. Equal pieces are settled by two 64-bit
hashes, without comparing bytes; that is where most repeats go. Pieces that differ but share an anchor go to shards; a shard's pieces get a suffix array
by induced sorting, and runs of suffixes with common prefixes of ``length`` bytes are the
repeated windows. The earliest of each run stays.

Anchors that a sample shows to be very frequent, and groups too large for one shard, are dealt
out window by window instead, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.common import batch, once, passed, passed_schema, prepare, quoted, rest, restored, spread, utf8
from tallybook.llm.suffix_array import permuted_common_prefixes, suffix_array
from tallybook.sources.scratch import materialize

RESULTS = ["n_bytes", "n_removed", "removed", "kept"]

_BLOCK = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)
_STEP = 0x9E3779B97F4A7C15

_ANCHORS = "core long, full long, d long, h long, l int, n int"
_FOUND = "d long, h long, l int, n int, core long"
_PIECES = "key long, d long, h long, l int, piece binary"
_ARROW = {
    _ANCHORS: pa.schema(
        [("core", pa.int64()), ("full", pa.int64()), ("d", pa.int64()), ("h", pa.int64()),
         ("l", pa.int32()), ("n", pa.int32())]
    ),
    _FOUND: pa.schema(
        [("d", pa.int64()), ("h", pa.int64()), ("l", pa.int32()), ("n", pa.int32()), ("core", pa.int64())]
    ),
    _PIECES: pa.schema(
        [("key", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("l", pa.int32()), ("piece", pa.binary())]
    ),
}
# Places an anchor can have in the first of its windows.
_PLACES = 1 << 16


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    anchor: int = 20,
    shard_bytes: int = 3 << 20,
    sample_docs: int = 4096,
    hot_anchors: int = 4096,
    as_text: bool = False,
    keep_text: bool = True,
) -> DataFrame:
    """Drop every byte covered by a ``length``-byte string that also starts earlier.

    Earlier means a smaller id, or an earlier start in the same document. Strings are judged on
    the input, overlaps count, and matches never cross documents. Returns the columns of ``docs``
    with ``n_bytes`` and ``n_removed`` (long), ``removed`` (maximal runs as structs of ``start``
    and ``end``, in bytes) and ``kept`` (the remaining bytes, or with ``as_text`` a string without the
    characters that were cut in two); an input column of such a name is replaced, and without
    ``keep_text`` the text is left out.

    ``length`` may exceed ``anchor`` by less than 65536, and ``anchor`` is at most half of it.
    Null and short texts lose nothing; a null text counts as empty. Rows without an id come after
    all others. Rows of one id and different texts are ordered by a hash of the text; rows equal
    in id and text count as one document, and each of them gets that document's result.

    An anchor that takes more than 1 in ``hot_anchors`` of the anchors of about ``sample_docs``
    documents is dealt out by windows; the list of them has at most ``hot_anchors`` entries. The
    sample decides how work is dealt out, never what is found.
    """
    if not 8 <= anchor <= length // 2:
        raise ValueError(f"anchor must be from 8 to half the length, got {anchor} and {length}")
    if length - anchor >= _PLACES:
        raise ValueError(f"length may be up to {_PLACES - 1} more than anchor, got {anchor} and {length}")
    prepare(docs.sparkSession)
    texts = docs.select(
        F.coalesce(quoted(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"),
        F.xxhash64(quoted(text_col)).alias("h"),
        quoted(text_col).cast("string").alias("text"),
    )
    hot = _hot_anchors(texts, length, anchor, sample_docs, hot_anchors)
    anchors = spread(texts, F.col("d"), F.col("h")).mapInArrow(_find_anchors(length, anchor, hot), _ANCHORS)
    found = materialize(_settle(anchors, length), "repeats")

    wanted = found.where("core IS NOT NULL")
    pieces = _beside(texts, wanted).mapInArrow(_cut_pieces(length, anchor), _PIECES)
    by_key = pieces.repartition("key").sortWithinPartitions("key", "d", "h", "l")
    sorted_shards = materialize(
        by_key.mapInArrow(_sort_shards(length, anchor, shard_bytes), _ANCHORS), "shards"
    )
    windows = _settle(sorted_shards.where("full IS NOT NULL"), length).where("core IS NULL")
    spans = (
        found.where("core IS NULL")
        .unionByName(
            sorted_shards.where("full IS NULL").select("d", "h", "l", "n", F.lit(None).cast("long").alias("core"))
        )
        .unionByName(windows)
        .select("d", "h", "l", "n")
    )

    whole = docs.select(
        F.coalesce(quoted(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"),
        F.xxhash64(quoted(text_col)).alias("h"),
        quoted(text_col).cast("string").alias("text"),
        rest(docs, [*RESULTS, text_col]).alias("rest"),
    )
    both = whole.select("d", "h", F.lit(1).alias("kind"), "text", "rest", F.lit(0).alias("l"), F.lit(0).alias("n"))
    both = both.unionByName(
        spans.select(
            "d", "h", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"),
            F.lit(None).cast(whole.schema["rest"].dataType).alias("rest"), "l", "n",
        )
    )
    dealt = both.repartition("d", "h").sortWithinPartitions("d", "h", "kind", "l")
    kept = "string" if as_text else "binary"
    result = passed_schema(
        whole, keep_text, f"n_bytes long, n_removed long, removed array<struct<start int, end int>>, kept {kept}"
    )
    cut = dealt.select("d", "h", "kind", "text", "l", "n", "rest").mapInArrow(_cut_texts(as_text, keep_text), result)
    return cut.select(*restored(docs, text_col, RESULTS, keep_text))


def _settle(anchors: DataFrame, length: int) -> DataFrame:
    """Group equal pieces and pieces of one anchor; see ``_settle_classes``."""
    dealt = anchors.repartition("core").sortWithinPartitions("core", "full", "d", "h", "l")
    return dealt.mapInArrow(_settle_classes(length), _FOUND)


def _beside(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text followed by the spans asked of it, in one partition and in order."""
    both = texts.select("d", "h", F.lit(0).alias("kind"), "text", F.lit(0).alias("l"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("core"))
    both = both.unionByName(
        spans.select("d", "h", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "l", "n", "core")
    )
    return both.repartition("d", "h").sortWithinPartitions("d", "h", "kind", "l")


def _hot_anchors(texts: DataFrame, length: int, anchor: int, sample_docs: int, hot_anchors: int) -> np.ndarray:
    """Hashes of anchors so frequent in a sample of documents that they are dealt out by window."""
    share = min(1.0, sample_docs / max(texts.count(), 1))
    sample = texts.sample(False, share, 42) if share < 1 else texts
    counts = (
        sample.mapInArrow(_find_anchors(length, anchor, np.zeros(0, dtype=np.int64)), _ANCHORS)
        .where("full IS NOT NULL")
        .groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").alias("total")
    needed = max(64, (counts.agg(total).first()["total"] or 0) // hot_anchors)
    rows = counts.where(F.col("n") >= needed).select("core").collect()
    return np.sort(np.array([r["core"] for r in rows], dtype=np.int64))


def _tables():
    """Random words for bytes, and powers of the step and of its inverse, modulo 2**64."""
    words = np.random.default_rng(20).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
    up = np.full(_BLOCK + 1, _STEP, dtype=np.uint64)
    down = np.full(_BLOCK + 1, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return words, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def _find_anchors(length: int, anchor: int, hot: np.ndarray):
    """Task function: texts in, their anchors out, with the windows each anchor is given.

    ``l`` is the first of an anchor's windows; ``n`` holds how many there are, times ``_PLACES``, plus the
    anchor's place in the first. Pieces equal to an earlier one of the same batch are not sent on:
    their bytes come out as spans at once, with ``full`` null. Windows of hot anchors come out
    one by one under their own hashes.
    """

    def of_block(b: np.ndarray, usable: np.ndarray):
        words, up, down = once("anchor_tables", _tables)
        size = len(b)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(words[0][b] * up[:size], out=sums[1:])
        hashes = _mixed((sums[anchor:] - sums[:-anchor]) * down[: size - anchor + 1])
        key = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_smallest(key, length - anchor + 1) & _PLACE).astype(np.int64)
        starts = np.concatenate(([True], (place[1:] != place[:-1]) | ~usable[:-1])) & usable
        ends = np.concatenate(((place[1:] != place[:-1]) | ~usable[1:], [True])) & usable
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        at = place[first]
        core = hashes[at].view(np.int64)
        full = _mixed((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        full = full.view(np.int64)
        many = np.isin(core, hot) if len(hot) else np.zeros(len(core), dtype=bool)
        packed = (last - first + 1) * _PLACES + at - first
        if many.any():
            second = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(words[1][b] * up[:size], out=second[1:])
            count = (last - first + 1)[many]
            each = np.repeat(first[many] - np.cumsum(count) + count, count) + np.arange(count.sum())
            own = [_mixed((s[each + length] - s[each]) * down[each]).view(np.int64) for s in (sums, second)]
            few = ~many
            core, full = np.concatenate((core[few], own[0])), np.concatenate((full[few], own[1]))
            first = np.concatenate((first[few], each))
            packed = np.concatenate((packed[few], np.full(len(each), _PLACES)))
        return core, full, first, packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            content, start = utf8(rows.column("text"))
            if len(content) < length:
                continue
            row = np.repeat(np.arange(len(start) - 1), np.diff(start))
            usable = np.zeros(len(content), dtype=bool)
            usable[: len(content) - length + 1] = row[: len(content) - length + 1] == row[length - 1 :]
            parts = []
            for at in range(0, len(content) - length + 1, _BLOCK - length + 1):
                part = content[at : at + _BLOCK]
                ok = usable[at : at + len(part) - length + 1]
                if ok.any():
                    core, full, first, packed = of_block(part, ok)
                    parts.append((core, full, first + at, packed))
            if not parts:
                continue
            core, full, first, packed = (np.concatenate(x) for x in zip(*parts))
            r = row[first]
            d = rows.column("d").to_numpy(zero_copy_only=False)[r]
            h = rows.column("h").to_numpy(zero_copy_only=False)[r]
            l = first - start[r]
            order = np.lexsort((l, h, d, full, core))
            core, full, d, h, l, packed = (x[order] for x in (core, full, d, h, l, packed))
            new = np.ones(len(core), dtype=bool)
            new[1:] = (core[1:] != core[:-1]) | (full[1:] != full[:-1])
            yield batch(_ARROW[_ANCHORS], core[new], full[new], d[new], h[new], l[new].astype(np.int32), packed[new].astype(np.int32))
            model = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = ~new & ((d != d[model]) | (h != h[model]) | (l != l[model]))
            if again.any():
                d, h, l, n = _joined(d[again], h[again], l[again], packed[again] // _PLACES - 1 + length)
                apart = _mixed(d.view(np.uint64) * np.uint64(31) + l.astype(np.uint64)).view(np.int64)
                yield batch(_ARROW[_ANCHORS], apart, pa.nulls(len(d), pa.int64()), d, h, l.astype(np.int32), n.astype(np.int32))

    return run


def _joined(d, h, l, n):
    """Overlapping and touching spans of each document made one."""
    order = np.lexsort((l, h, d))
    d, h, l, n = d[order], h[order], l[order], n[order]
    other = np.ones(len(d), dtype=bool)
    other[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    base = np.cumsum(other).astype(np.int64) << 32
    reach = np.maximum.accumulate(base + l + n)
    new = other.copy()
    new[1:] |= base[1:] + l[1:] > reach[:-1]
    first = np.flatnonzero(new)
    end = reach[np.append(first[1:], len(d)) - 1] - base[first]
    return d[first], h[first], l[first], end - l[first]


def _settle_classes(length: int):
    """Task function over rows sorted by anchor, piece and place.

    Of equal pieces the first stays and the others come out as spans (``core`` null). The first
    pieces of an anchor that has several different ones come out with their anchor, to be cut.
    Spans that come in already settled are handed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW[_FOUND]
        held = None  # The first piece of the last class so far, if its anchor has no other yet.
        last = model = None
        for rows in batches:
            settled = rows.column("full").is_null().to_numpy(zero_copy_only=False)
            names = ("d", "h", "l", "n", "core")
            if settled.any():
                done = rows.filter(pa.array(settled))
                yield batch(schema, *[done.column(c) for c in names[:-1]], pa.nulls(len(done), pa.int64()))
                rows = rows.filter(pa.array(~settled))
            if rows.num_rows == 0:
                continue
            core, full, d, h, l, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("core", "full", "d", "h", "l", "n"))
            new_core = np.ones(len(core), dtype=bool)
            new_core[1:] = core[1:] != core[:-1]
            new = new_core.copy()
            new[1:] |= full[1:] != full[:-1]
            if last is not None:
                new_core[0] = core[0] != last[0]
                new[0] = new_core[0] or full[0] != last[1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            known = lead >= 0
            md, mh, ml = (np.where(known, x[lead], 0 if model is None else model[i]) for i, x in enumerate((d, h, l)))
            again = ~new & ((d != md) | (h != mh) | (l != ml))
            if again.any():
                yield batch(schema, d[again], h[again], l[again], (n[again] // _PLACES - 1 + length).astype(np.int32), pa.nulls(int(again.sum()), pa.int64()))
            heads = np.flatnonzero(new)
            if len(heads):
                several = ~new_core[heads]
                several[:-1] |= ~new_core[heads[1:]]
                if held is not None and not new_core[heads[0]]:
                    yield batch(schema, *[[x] for x in held])
                if held is not None:
                    held = None
                tail = heads[-1]
                if not several[-1]:
                    held = (d[tail], h[tail], l[tail], n[tail], core[tail])
                out = heads[several]
                if len(out):
                    yield batch(schema, d[out], h[out], l[out], n[out], core[out])
            tail = lead[-1]
            if tail >= 0:
                model = (d[tail], h[tail], l[tail])
            last = (core[-1], full[-1])

    return run


def _cut_pieces(length: int, anchor: int):
    """Task function over texts with the pieces asked of them: their bytes, in two halves.

    A window reaches at least half of what an anchor leaves of it to the left or to the right, so
    two pieces can only share a window if they agree there. The halves travel under a hash of the
    anchor with that side.
    """
    side = (length - anchor) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, owner = b"", None
        for rows in batches:
            out: list[tuple] = []
            kinds, texts = rows.column("kind").to_pylist(), rows.column("text")
            d, h, l, n, core = (rows.column(c).to_pylist() for c in ("d", "h", "l", "n", "core"))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    owner, text_at = (d[i], h[i]), i
                    text = None
                    continue
                if text is None:
                    text = (texts[text_at].as_py() or "").encode()
                if owner != (d[i], h[i]):
                    continue
                first, count, at = l[i], n[i] // _PLACES, l[i] + n[i] % _PLACES
                end = first + count  # behind the last window's start
                middle = min(max(at - side + 1, first), end)
                if middle > first:
                    key = xxhash.xxh64_intdigest(text[at - side : at + anchor], core[i] & 0xFFFFFFFF)
                    out.append((key, d[i], h[i], first, text[first : middle - 1 + length]))
                if end > middle:
                    key = xxhash.xxh64_intdigest(text[at : at + anchor + side], ~core[i] & 0xFFFFFFFF)
                    out.append((key, d[i], h[i], middle, text[middle : end - 1 + length]))
            if text is None:
                text = (texts[text_at].as_py() or "").encode()
            if out:
                key, *columns = zip(*out)
                yield batch(_ARROW[_PIECES], np.array(key, dtype=np.uint64).view(np.int64), *columns)

    return run


def _sort_shards(length: int, anchor: int, shard_bytes: int):
    """Task function over pieces sorted by key: spans of repeated windows (``full`` null).

    Keys of one piece are passed over, equal pieces of a key are settled at once, and the others
    are gathered into shards of about ``shard_bytes`` and sorted. Windows of a key that alone has
    more come out one by one under their hashes.
    """

    def windows(places: list[tuple], pieces: list[bytes]):
        for (d, h, l), piece in zip(places, pieces):
            for i in range(len(piece) - length + 1):
                window = piece[i : i + length]
                yield xxhash.xxh64_intdigest(window, 1), xxhash.xxh64_intdigest(window, 2), d, h, l + i, _PLACES

    def spans(places: list[tuple], pieces: list[bytes]) -> pa.RecordBatch | None:
        d, h, l, size = _repeats_in_shard(places, pieces, length)
        if len(d) == 0:
            return None
        d, h, l, n = _joined(d, h, l, size)
        return batch(_ARROW[_ANCHORS], np.zeros(len(d), dtype=np.int64), pa.nulls(len(d), pa.int64()), d, h, l.astype(np.int32), n.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[tuple] = []
        pieces: list[bytes] = []
        held = 0
        group: dict[bytes, tuple] = {}
        group_bytes, overflow, current = 0, False, None
        again: list[tuple] = []

        def spilled():
            rows = list(windows(list(group.values()), list(group)))
            columns = [np.array(c, dtype=np.uint64).view(np.int64) if i < 2 else list(c) for i, c in enumerate(zip(*rows))]
            return batch(_ARROW[_ANCHORS], *columns)

        def close():
            nonlocal held, group, group_bytes, overflow
            if overflow:
                if group:
                    yield spilled()
            elif len(group) > 1:
                places.extend(group.values())
                pieces.extend(group)
                held += group_bytes
            group, group_bytes, overflow = {}, 0, False
            if held >= shard_bytes:
                found = spans(places, pieces)
                if found is not None:
                    yield found
                places.clear()
                pieces.clear()
                held = 0

        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("key", "d", "h", "l", "piece")]
            for key, d, h, l, piece in zip(*columns):
                if key != current:
                    yield from close()
                    current = key
                model = group.get(piece)
                if model is None:
                    group[piece] = (d, h, l)
                    group_bytes += len(piece)
                    if group_bytes >= shard_bytes:
                        overflow = True
                        yield spilled()
                        group, group_bytes = {}, 0
                elif model != (d, h, l):
                    again.append((0, None, d, h, l, len(piece)))
            if again:
                yield batch(_ARROW[_ANCHORS], *[list(c) for c in zip(*again)])
                again.clear()
        yield from close()
        if len(places) > 1:
            found = spans(places, pieces)
            if found is not None:
                yield found

    return run


def _repeats_in_shard(places: list[tuple], pieces: list[bytes], length: int):
    """Document, hash, start and size of every window of a shard that has an earlier equal one.

    Bytes are raised by one and pieces end in a 0, so a common prefix of ``length`` symbols without
    a 0 in it is a repeated window.
    """
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.int32) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order, length)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    begins = ends - sizes
    whole = order + length < ends[owner[order]]
    order, joined = order[whole], (shared[order] >= length)[whole]
    run = np.cumsum(~joined)
    d, h, l = (np.array(x, dtype=np.int64) for x in zip(*places))
    o = owner[order]
    d, h, l = d[o], h[o], l[o] + order - begins[o]
    by = np.lexsort((l, h, d, run))
    run, d, h, l = run[by], d[by], h[by], l[by]
    first = np.ones(len(run), dtype=bool)
    first[1:] = run[1:] != run[:-1]
    model = np.flatnonzero(first)[np.cumsum(first) - 1] if len(run) else np.zeros(0, dtype=np.int64)
    again = (d != d[model]) | (h != h[model]) | (l != l[model])
    d, h, l = d[again], h[again], l[again]
    return d, h, l, np.full(len(d), length)


def _cut_texts(as_text: bool, keep_text: bool):
    """Task function over texts behind the spans found in them: what remains, and the runs that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple] = []
        owner = None
        for rows in batches:
            kinds = rows.column("kind").to_numpy(zero_copy_only=False)
            d, h, l, n = (rows.column(c).to_pylist() for c in ("d", "h", "l", "n"))
            texts = rows.column("text")
            chosen = np.flatnonzero(kinds == 1)
            sizes, removed, runs, kept = [], [], [], []
            for i, kind in enumerate(kinds):
                if owner != (d[i], h[i]):
                    owner, spans = (d[i], h[i]), []
                if kind == 0:
                    if spans and l[i] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], l[i] + n[i]))
                    else:
                        spans.append((l[i], l[i] + n[i]))
                    continue
                text = (texts[int(i)].as_py() or "").encode()
                sizes.append(len(text))
                removed.append(sum(e - s for s, e in spans))
                runs.append([{"start": s, "end": e} for s, e in spans])
                edges = [0, *[x for s in spans for x in s], len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else text
                kept.append(left.decode(errors="ignore") if as_text else left)
            if len(chosen):
                spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield passed(
                    rows.select(["rest", "text"]).take(pa.array(chosen)),
                    keep_text,
                    n_bytes=pa.array(sizes, pa.int64()),
                    n_removed=pa.array(removed, pa.int64()),
                    removed=pa.array(runs, spans_type),
                    kept=pa.array(kept, pa.string() if as_text else pa.binary()),
                )

    return run
