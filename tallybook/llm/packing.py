"""Packing examples into sequences: vector bin packing with a dot-product heuristic.

An example takes tokens, segments and loss-bearing tokens; a sequence has a limit on each. A
sequence is filled by the example whose demands, weighted by what is scarce in the window of
waiting examples, point most into the room that is left. Room that no waiting example fits is
filled by cutting one, and what a task has left over at its end is cut into sequences of a power
of two, which need no padding. Tasks pack what they read, so nothing is shuffled and memory is bounded by the window.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallybook.llm.bpe import byte_symbols
from tallybook.llm.common import once, prepare, quoted, spread

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, loss_tokens long, ids binary"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


# A document's piece has a token at least, so as many segments as tokens never close a sequence.
TOKENS_ONLY = Limits(segments=Limits.tokens)


def pack_documents(
    docs: DataFrame,
    vocabulary: bytes,
    limits: Limits = TOKENS_ONLY,
    end_id: int = 1,
    window: int = 512,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize texts, end each with ``end_id`` and pack them; one row per piece (``PIECES``).

    ``vocabulary`` is the content of a tokenizer file of the tokenizers library. Every id lies in
    exactly one piece; ``start`` counts the ids of its document before it, ``offset`` the place in
    its sequence, ``ids`` are little-endian 32-bit integers. All ids of a document bear loss. By
    default only tokens are limited, so that many short texts fill a sequence as well. A null text is only ``end_id``; rows without an id and repeated rows are packed like any other.

    Sequences are numbered by task and place, so numbers are unique but not dense; a lost task is
    packed anew as a whole. Without ``keep_ids`` the ids themselves are null.
    """
    prepare(docs.sparkSession)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    # Rows come out of a shuffle in any order; sorted, a task that is run again packs the same.
    texts = spread(texts, F.col("id"), F.col("text")).sortWithinPartitions("id", "text")
    numbered = texts.withColumn("task", F.spark_partition_id())
    return numbered.mapInArrow(_pack_texts(shared, limits, end_id, window, keep_ids), PIECES)


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),
    window: int = 512,
    id_col: str = "example_id",
    tokens_col: str = "n_tokens",
    segments_col: str = "n_segments",
    loss_col: str = "n_loss",
) -> DataFrame:
    """Place whole examples, such as conversations, under all three limits.

    Returns the id, ``sequence_id`` and ``offset``. Examples are not cut; null demands count as 0.
    An example that alone is over a limit gets a sequence of its own. Segments and loss-bearing
    tokens of a sequence never exceed the limits otherwise.
    """
    prepare(examples.sparkSession)
    demands = [F.coalesce(quoted(c).cast("long"), F.lit(0)).alias(n) for c, n in ((tokens_col, "tokens"), (segments_col, "segments"), (loss_col, "loss"))]
    rows = examples.select(quoted(id_col).alias("id"), *demands, F.spark_partition_id().alias("task"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, sequence_id long, offset long"
    return rows.mapInArrow(_place_examples(limits, window), schema).withColumnRenamed("id", id_col)


def best_fitting(demands: np.ndarray, weights: np.ndarray, room: np.ndarray) -> int:
    """The demand that fits and points most into the room left, -1 if none fits."""
    score = demands @ (weights * room)
    score[(demands > room).any(axis=1)] = -1.0
    best = int(score.argmax()) if len(score) else -1
    return best if best >= 0 and score[best] >= 0 else -1


def _scarcity(demands: np.ndarray) -> np.ndarray:
    """Weight of each dimension: the share of a sequence the waiting examples take on average."""
    return demands.mean(axis=0) + 1e-12


def _place_examples(limits: Limits, window: int):
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        number = task = 0
        kind = None

        def fill(done: list[tuple]) -> None:
            """One sequence; its first example is the largest that waits."""
            nonlocal number
            demands = np.array([d for _, d in waiting]) / most
            weights, room, offset = _scarcity(demands), np.ones(3), 0
            gone = np.zeros(len(waiting), dtype=bool)
            at = int(demands.max(axis=1).argmax())
            while at >= 0:
                gone[at] = True
                done.append((waiting[at][0], task << 33 | number, offset))
                offset += int(waiting[at][1][0])
                room = np.maximum(room - demands[at], 0)
                if (demands[at] > 1).any():
                    break
                open_ = np.flatnonzero(~gone)
                found = best_fitting(demands[open_], weights, room + 1e-9)
                at = int(open_[found]) if found >= 0 else -1
            number += 1
            waiting[:] = [w for w, g in zip(waiting, gone) if not g]

        def out(done: list[tuple]) -> pa.RecordBatch:
            ids, sequence, offset = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["id", "sequence_id", "offset"],
            )

        for rows in batches:
            kind = rows.schema.field("id").type
            if len(rows):
                task = rows.column("task")[0].as_py()
            done: list[tuple] = []
            for i, *demand in zip(*[rows.column(c).to_pylist() for c in ("id", "tokens", "segments", "loss")]):
                waiting.append((i, np.array(demand, dtype=np.float64)))
                while len(waiting) >= window:
                    fill(done)
            if done:
                yield out(done)
        done = []
        while waiting:
            fill(done)
        if done:
            yield out(done)

    return run


def _pack_texts(shared, limits: Limits, end_id: int, window: int, keep_ids: bool):
    most = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    full = limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(f"encoder_{hashlib.md5(shared.value).hexdigest()}", lambda: _encoder(shared.value))
        end = np.array([end_id], dtype="<u4").tobytes()
        waiting: list[list] = []  # id, start, ids, tokens of the document
        rows_out: list[tuple] = []
        number = task = held = 0  # held: tokens that wait

        def put(piece: list, length: int, offset: int) -> list | None:
            """The first ``length`` ids of a piece into the current sequence; the remaining piece."""
            i, start, ids, total = piece
            own = ids[: 4 * length]
            rows_out.append((i, start, length, crc32(own), total, task << 33 | number, offset, length, bytes(own) if keep_ids else None))
            return [i, start + length, ids[4 * length :], total] if len(ids) > 4 * length else None

        def fill(target: int) -> None:
            """One sequence of exactly ``target`` tokens if the segments allow, of fewer otherwise."""
            nonlocal number, held
            sizes = np.array([len(w[2]) // 4 for w in waiting], dtype=np.float64)
            demands = np.stack((sizes, np.ones(len(sizes)), sizes), axis=1) / most
            weights = _scarcity(demands)
            gone = np.zeros(len(waiting), dtype=bool)
            left, segments, offset = float(target), limits.segments, 0
            back: list[list] = []
            while left > 0 and segments > 0 and not gone.all():
                room = np.array([left, segments, min(left, limits.loss_tokens - offset)]) / most
                open_ = np.flatnonzero(~gone)
                found = best_fitting(demands[open_], weights, room + 1e-12) if segments > 1 else -1
                at = int(open_[found]) if found >= 0 else int(open_[sizes[open_].argmax()])
                length = int(min(sizes[at], left))
                gone[at] = True
                remaining = put(waiting[at], length, offset)
                if remaining is not None:
                    back.append(remaining)
                left, segments, offset = left - length, segments - 1, offset + length
            number += 1
            held -= offset
            waiting[:] = [w for w, g in zip(waiting, gone) if not g] + back

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows_out))
            rows_out.clear()
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for rows in batches:
            if len(rows):
                task = rows.column("task")[0].as_py()
            for i, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                ids = memoryview(encode(text or "") + end)
                piece: list | None = [i, 0, ids, len(ids) // 4]
                while piece is not None and len(piece[2]) >= 4 * full:
                    piece = put(piece, full, 0)
                    number += 1
                if piece is not None:
                    waiting.append(piece)
                    held += len(piece[2]) // 4
                    if len(waiting) >= window:
                        while len(waiting) > window // 2 and held >= full:
                            fill(full)
                if len(rows_out) >= 2000:
                    yield flush()
        while waiting:
            # Sizes that are powers of two need no padding; segments may end a sequence before.
            fill(full if held >= full else 1 << (held.bit_length() - 1))
        if rows_out:
            yield flush()

    return run


# How a byte-level vocabulary of this kind splits text, and the longest word to split that way.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONGEST = 1000
# Below this character the two libraries have the same letters, numbers and white space.
_COMMON = re.compile("[\0-\u024f]*").fullmatch


def _encoder(vocabulary: bytes):
    """A function from text to ids as little-endian 32-bit integers.

    Ids are those of the tokenizers library. Usual texts go through tiktoken with the same file's
    vocabulary, which gives the same ids faster; texts with other characters, special tokens or
    very long words go through the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode())
    content = json.loads(vocabulary)
    special = [t["content"] for t in content["added_tokens"]]
    byte_of = {symbol: byte for byte, symbol in byte_symbols().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items()}
    usual = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if _COMMON(text) and not any(s in text for s in special) and max(map(len, text.split()), default=0) <= _LONGEST:
            ids = usual.encode_ordinary(text)
        else:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    return encode
