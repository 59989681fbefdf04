"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its letter n-grams, hashed into a fixed number of buckets and
scaled to length 1. Document frequencies come from all learnable rows; the centroids are the
centres of spherical clusters of a bounded sample of each language. A text gets the language of
the centroid with the largest cosine, and is marked as rejected if that is too far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallybook.llm.common import carried, batch, once, prepare, passed, passed_schema, restored, quoted, spread

RESULTS = ["lang_pred", "score", "rejected"]
UNKNOWN = "und"
BUCKETS = 1 << 13


@dataclass(frozen=True)
class LanguageModel:
    """What ``fit_languages`` learned: languages, the weight of each bucket, centroids and limits."""

    languages: tuple[str, ...]
    idf: np.ndarray  # BUCKETS
    centroids: np.ndarray  # rows of length 1
    owner: np.ndarray  # language of each row
    limit: np.ndarray  # least cosine that is not rejected, for each row


def fit_languages(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    clusters: int = 3,
    rows_per_language: int = 512,
    most_languages: int = 256,
    rounds: int = 8,
    rejected: float = 0.002,
) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and the language and the text are known.

    Document frequencies cover all of them. Centroids are fitted on about ``rows_per_language`` rows
    of each language (all, if there are fewer), chosen by a hash of id and text, and at most 4096 rows
    in all; the ``rejected`` share of a language's that lies farthest from its centroids sets the
    limit of rejection of each of them. More than ``most_languages`` languages raise an error. Without any learnable row the
    model knows no language and everything is unknown.
    """
    prepare(docs.sparkSession)
    rows = docs.where(learn).select(
        quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang")
    )
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = tuple(sorted(counts))
    if not languages:
        none = np.zeros(0)
        return LanguageModel((), np.ones(BUCKETS), np.zeros((0, BUCKETS), dtype=np.float32), none.astype(int), none)
    frequencies = spread(rows, F.col("id"), F.col("text")).select("text").mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS)
    for r in frequencies.collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1

    wanted = min(rows_per_language, max(1, 4096 // len(languages)))
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, wanted / n))])
    draw = (F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    sample = rows.where(draw < shares[F.col("lang")]).limit(8192).select("lang", "text")
    vectors, owner = [], []
    for r in sample.mapInArrow(_vectors(idf), "lang string, vector binary").collect():
        vectors.append(np.frombuffer(r["vector"], dtype=np.float16).astype(np.float32))
        owner.append(languages.index(r["lang"]))
    vectors, owner = np.array(vectors, dtype=np.float32).reshape(-1, BUCKETS), np.array(owner, dtype=int)
    centroids, of, limit = [], [], []
    for k in range(len(languages)):
        own = vectors[owner == k]
        if len(own):
            found = _clusters(own, clusters, rounds)
            near = (own @ found.T).max(axis=1)
            centroids.append(found)
            of += [k] * len(found)
            limit += [float(np.quantile(near, rejected))] * len(found)
    return LanguageModel(languages, idf, np.concatenate(centroids or [np.zeros((0, BUCKETS), dtype=np.float32)]), np.array(of, dtype=int), np.array(limit))


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``.

    ``score`` is the cosine to the nearest centroid, ``rejected`` tells that it is below that
    centroid's limit. Whole texts count. Null texts and texts without a letter are ``und`` with
    score 0 and rejected. Ties go to the language first by name. Repeated rows each come out; input
    columns of the result's names are replaced, and without ``keep_text`` the text is left out.
    """
    prepare(docs.sparkSession)
    # Plain values: executors may not have this module, whose class a broadcast would name.
    values = model.languages, model.idf, model.centroids, model.owner, model.limit
    shared = docs.sparkSession.sparkContext.broadcast(values)
    texts = carried(docs, id_col, text_col, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, centroids, owner, limit = shared.value
        for rows in batches:
            languages, scores, far = [], [], []
            for text in rows.column("text").to_pylist():
                language, score, rejected = UNKNOWN, 0.0, True
                if text and len(owner) and has_letter(text):
                    weights = grams(text) * idf
                    length = float(np.sqrt(weights @ weights))
                    cosines = centroids @ (weights / max(length, 1e-12)).astype(np.float32)
                    best = int(cosines.argmax())
                    language, score = names[owner[best]], float(np.clip(cosines[best], 0, 1))
                    rejected = score < limit[best]
                languages.append(language)
                scores.append(score)
                far.append(bool(rejected))
            found = pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())
            yield passed(rows, keep_text, **dict(zip(RESULTS, found)))

    schema = passed_schema(texts, keep_text, "lang_pred string, score double, rejected boolean")
    found = spread(texts, F.col("id"), F.col("text")).select("text", "rest").mapInArrow(run, schema)
    return found.select(*restored(docs, text_col, RESULTS, keep_text))


def has_letter(text: str) -> bool:
    return not text.isascii() and any(map(str.isalpha, text)) or text.isascii() and text.upper() != text.lower()


def counts_of(text: str) -> np.ndarray:
    """How many 1-, 2- and 3-grams of a text each bucket has; what is no letter counts as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = once("letters", _letters)
    codes = np.where(letters[np.minimum(codes, len(letters) - 1)], codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    found = np.bincount(_bucket(codes), minlength=BUCKETS)
    hashed = codes
    for n in (2, 3):
        if len(codes) >= n:
            hashed = hashed[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            found += np.bincount(_bucket(hashed + np.uint32(n)), minlength=BUCKETS)
    return found


def grams(text: str) -> np.ndarray:
    """The counts, damped."""
    found = counts_of(text).astype(np.float64)
    some = np.flatnonzero(found)
    found[some] = np.log1p(found[some])
    return found


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)


def _letters() -> np.ndarray:
    """Which code points are letters; the last entry stands for all planes behind the first."""
    found = np.array([chr(i).isalpha() for i in range(0x10000)], dtype=bool)
    return np.append(found, True)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, dtype=np.int64)
    for rows in batches:
        for text in rows.column("text").to_pylist():
            found += counts_of(text) > 0
    chosen = np.flatnonzero(found)
    yield batch(pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), chosen.astype(np.int32), found[chosen])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for text in rows.column("text").to_pylist():
                weights = grams(text) * idf
                out.append((weights / max(np.sqrt(weights @ weights), 1e-12)).astype(np.float16).tobytes())
            yield batch(pa.schema([("lang", pa.string()), ("vector", pa.binary())]), rows.column("lang"), out)

    return run


def _clusters(vectors: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    """Centres of spherical k-means; the first centre is the mean, each next one the row farthest from all."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(clusters, len(vectors)):
        near = (vectors @ _unit(np.array(centres)).T).max(axis=1)
        centres.append(vectors[int(near.argmin())])
    found = _unit(np.array(centres))
    for _ in range(rounds):
        of = (vectors @ found.T).argmax(axis=1)
        found = _unit(np.array([vectors[of == k].mean(axis=0) if (of == k).any() else found[k] for k in range(len(found))]))
    return found.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
