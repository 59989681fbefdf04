"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Texts are folded to 28 symbols: accents and case go, look-alike digits become letters, punctuation
is dropped and white space becomes one border. That holds for Latin letters and signs below U+0250;
every character from there on, of other scripts and punctuation alike, folds to one symbol, so texts
in them cannot be told apart. The kernel compares two strings by the sequences of
four symbols they share, gaps of up to three symbols allowed and each gap counted less, so an
insult with an inserted character still meets its plain form.

Landmarks are words of labelled sentences. In the Nyström space they span, a linear support vector
machine is trained on the best window of each labelled document and on windows of clean ones. Its
decision is a weighted sum of kernels with the landmarks, and the kernel is a sum over shared
sequences, so the machine is kept as one weight for each of the ``2 ** 20`` sequences.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.llm.common import carried, once, prepare, passed, passed_schema, restored, quoted, spread

RESULTS = ["toxicity"]

BORDER = 28
_OTHER = 27
# Digits and signs that stand for letters.
_LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLDED = 0x250
_SPAN = 7
_GAP = 0.6
_WINDOW = 10
_REACH = _WINDOW + _SPAN - 1
_CHUNK = 1 << 17


@dataclass(frozen=True)
class ToxicityModel:
    """Weight of each sequence of four symbols, and how a window's sum becomes a probability."""

    weights: np.ndarray
    slope: float
    offset: float


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """The columns of ``docs`` with ``toxicity``, the probability (0 to 1) that a text is toxic.

    The best window of the whole text decides. Null and empty texts get the score of a text
    without any shared sequence. Repeated rows each come out; an input column of that name is
    replaced, and without ``keep_text`` the text is left out.
    """
    prepare(docs.sparkSession)
    # Plain values: executors may not have this module, whose class a broadcast would name.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.slope, model.offset))
    texts = carried(docs, id_col, text_col, RESULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = shared.value
        for rows in batches:
            best = _best_windows([t or "" for t in rows.column("text").to_pylist()], weights)[0]
            scores = 1 / (1 + np.exp(-np.clip(slope * best + offset, -50, 50)))
            yield passed(rows, keep_text, toxicity=pa.array(scores, pa.float64()))

    schema = passed_schema(texts, keep_text, "toxicity double")
    found = spread(texts, F.col("id"), F.col("text")).select("text", "rest").mapInArrow(run, schema)
    return found.select(*restored(docs, text_col, RESULTS, keep_text))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    docs_per_class: int = 1000,
    chars_per_doc: int = 8000,
    landmarks: int = 320,
    rounds: int = 3,
    cost: float = 1.0,
) -> ToxicityModel:
    """Train on labelled documents for whose ids ``learn`` holds.

    ``learn`` is a condition on the id column of ``labels``. About ``docs_per_class`` documents of
    each label, chosen by a hash of the id, and about ``chars_per_doc`` characters of the
    sentences of each, chosen by a hash, are gathered; these bounds concern training alone. Null labels are ignored and
    a document with several labels counts as toxic if one says so. Without documents of both
    labels, or any word that tells them apart, every text scores 0.
    """
    prepare(docs.sparkSession)
    known = labels.where(learn & quoted(id_col).isNotNull() & quoted(label_col).isNotNull())
    known = known.groupBy(quoted(id_col).cast("long").alias("id")).agg(F.max(quoted(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(np.zeros(1 << 20, dtype=np.float32), 0.0, -50.0)
    unit = float(1 << 30)
    draw = F.xxhash64("id", F.lit(1)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(unit)
    share = F.when(F.col("label") == 1, min(1.0, docs_per_class / counts[1])).otherwise(min(1.0, docs_per_class / counts[0]))
    chosen = known.where(draw < share).limit(4 * docs_per_class)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").where("text IS NOT NULL")
    sentences = texts.select(
        "id", "label", F.length("text").alias("n"), F.explode(F.split("text", r"(?<=[.!?\n])\s+")).alias("sentence")
    )
    sentence_draw = F.xxhash64("id", "sentence").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(unit)
    sentences = sentences.where(sentence_draw * F.col("n") < chars_per_doc)
    # An id read in many times, and a sentence a text repeats, count once; no id gathers without bound.
    drawn = sentences.groupBy("id", "sentence").agg(F.max("label").alias("label"), F.min(sentence_draw).alias("draw"))
    drawn = drawn.withColumn("sentence", F.substring("sentence", 1, chars_per_doc))
    before = Window.partitionBy("id").orderBy("draw", "sentence")
    drawn = drawn.withColumn("chars", F.sum(F.length("sentence")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = drawn.where(F.col("chars") <= 4 * chars_per_doc).select("id", "label", "sentence").collect()
    return _train(rows, landmarks, rounds, cost)


def _train(rows: list, landmarks: int, rounds: int, cost: float) -> ToxicityModel:
    """The machine from labelled sentences (id, label, sentence)."""
    rows = sorted(map(tuple, rows))
    ids = sorted({r[0] for r in rows})
    place = {i: k for k, i in enumerate(ids)}
    label = np.zeros(len(ids), dtype=int)
    sentences: list[list[str]] = [[] for _ in ids]
    for i, y, sentence in rows:
        label[place[i]] = y
        sentences[place[i]].append(sentence)
    texts = ["\n".join(s) for s in sentences]

    words = [{w for w, _ in _words(fold(t))} for t in texts]
    with_word = [Counter(w for k, own in enumerate(words) if label[k] == y for w in own) for y in (0, 1)]
    size = np.bincount(label, minlength=2) + 1

    def told(w: tuple) -> float:
        """How far a word's shares in both labels differ, against how common it is."""
        a, b = with_word[0][w] / size[0], with_word[1][w] / size[1]
        return (b - a) * abs(b - a) / (a + b)

    telling = sorted(with_word[1], key=lambda w: (-told(w), w))
    rng = np.random.default_rng(3)
    usual = sorted(with_word[0])
    some = rng.choice(len(usual), min(len(usual), landmarks // 2), replace=False) if usual else []
    marks = [w for w in dict.fromkeys([*telling[: landmarks - len(some)], *[usual[i] for i in some]])]

    if not telling:
        return ToxicityModel(np.zeros(1 << 20, dtype=np.float32), 0.0, -50.0)
    features = [_features(np.array([BORDER, *w, BORDER], dtype=np.int32)) for w in marks]
    ids_of = {u: k for k, u in enumerate(sorted({u for f in features for u in f}))}
    matrix = np.zeros((len(ids_of) + 1, len(marks)), dtype=np.float32)
    for j, f in enumerate(features):
        norm = np.sqrt(sum(x * x for x in f.values()))
        for u, x in f.items():
            matrix[ids_of[u], j] = x / norm
    sequences = np.array(sorted(ids_of), dtype=np.int64)
    row_of = np.full(1 << 20, len(ids_of), dtype=np.int32)
    row_of[sequences] = np.arange(len(sequences))
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])

    # Labels err, and most of a toxic text is harmless: only windows at telling words teach.
    value = {w: told(w) for w in telling if with_word[1][w] >= 3 and told(w) > 0.001}
    toxic = [w for k in np.flatnonzero(label == 1) for w in _telling_windows(texts[k], value)]
    toxic = np.array(toxic, dtype=np.int32).reshape(-1, _REACH)
    if not len(toxic):
        return ToxicityModel(np.zeros(1 << 20, dtype=np.float32), 0.0, -50.0)
    toxic = np.concatenate((toxic, _with_insertions(toxic, rng)))
    clean = [t for t, y in zip(texts, label) if y == 0]
    harmless = _random_windows(clean, rng)
    for _ in range(rounds):
        x = np.concatenate((toxic, harmless))
        y = np.concatenate((np.ones(len(toxic)), -np.ones(len(harmless))))
        w, _ = _machine(_kernel(x, row_of, matrix) @ whiten, y, cost)
        weights = _table(sequences, matrix, whiten @ w)
        harmless = np.unique(np.concatenate((harmless, _best_windows(clean, weights)[1])), axis=0)
    # Clean texts weigh most, so that few of them are rejected for a likeness to an inserted form.
    shown = _kernel(toxic, row_of, matrix) @ (whiten @ w)
    best, _ = _best_windows(clean, weights)
    scores, is_toxic = np.concatenate((shown, best)), np.repeat((1, 0), (len(shown), len(best)))
    slope, offset = _probability(scores, is_toxic, np.where(is_toxic, 1.0, 12.0 * len(shown) / len(best)))
    return ToxicityModel(weights, slope, offset)


def fold(text: str) -> np.ndarray:
    """The symbols of a text, a border at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = once("toxicity_folds", _folds)
    found = table[np.minimum(codes, _FOLDED)]
    found = np.concatenate(([BORDER], found[found > 0], [BORDER])).astype(np.int32)
    border = found == BORDER
    found = found[np.concatenate(([True], ~(border[1:] & border[:-1])))]
    # Letters spelled one by one are one word.
    border = found == BORDER
    inner = np.zeros(len(found), dtype=bool)
    inner[2:-2] = border[2:-2] & border[:-4] & border[4:]
    return found[~inner]


def _folds() -> np.ndarray:
    table = np.zeros(_FOLDED + 1, dtype=np.uint8)
    for code in range(_FOLDED):
        char = _LOOK_ALIKE.get(chr(code), chr(code))
        base = unicodedata.normalize("NFD", char.lower())[0]
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif char.isspace():
            table[code] = BORDER
        elif char.isalpha():
            table[code] = _OTHER
    table[_FOLDED] = _OTHER
    return table


def _words(symbols: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Words of three symbols and more, each with the place of the border before it."""
    cuts = np.flatnonzero(symbols == BORDER).tolist()
    return [(tuple(symbols[a + 1 : b].tolist()), a) for a, b in zip(cuts, cuts[1:]) if 3 < b - a < 24]


def _telling_windows(text: str, value: dict[tuple, float], most: int = 3) -> list[np.ndarray]:
    """Windows at the most telling words of a text, one for each word."""
    symbols = fold(text)
    found = {w: a for w, a in _words(symbols) if w in value}
    padded = np.concatenate((symbols, np.zeros(_REACH, dtype=np.int32)))
    chosen = sorted(found, key=lambda w: (-value[w], w))[:most]
    return [padded[found[w] : found[w] + _REACH] for w in chosen]


def _with_insertions(windows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows once more, a random letter inserted into the word each begins with."""
    length = 1 + np.argmax(windows[:, 1:] == BORDER, axis=1)
    length = np.where(length > 3, length, 4)
    at = 2 + (rng.random(len(windows)) * (length - 2)).astype(int)
    place = np.arange(_REACH)[None, :]
    moved = np.take_along_axis(windows, np.maximum(place - (place > at[:, None]), 0), axis=1)
    return np.where(place == at[:, None], rng.integers(1, 27, (len(windows), 1)), moved).astype(np.int32)


def _steps() -> list[tuple[int, int, int, float]]:
    """Places of the second to fourth symbol behind the first, and what the gaps leave of the weight."""
    return [
        (a, b, c, _GAP ** (c - 3))
        for a in range(1, _SPAN - 2)
        for b in range(a + 1, _SPAN - 1)
        for c in range(b + 1, _SPAN)
    ]


def _features(symbols: np.ndarray) -> dict[int, float]:
    """Weights of the sequences of a short string."""
    found: dict[int, float] = {}
    for a, b, c, weight in _steps():
        for i in range(len(symbols) - c):
            u = int(symbols[i]) << 15 | int(symbols[i + a]) << 10 | int(symbols[i + b]) << 5 | int(symbols[i + c])
            found[u] = found.get(u, 0.0) + weight
    return found


def _sums(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place, the weighted sum of the sequences that start there."""
    n = len(symbols) - _SPAN + 1
    first, second, third = symbols << 15, symbols << 10, symbols << 5
    total = np.zeros(n, dtype=np.float32)
    for a, b, c, weight in _steps():
        u = first[:n] | second[a : a + n] | third[b : b + n] | symbols[c : c + n]
        total += weights[u] * np.float32(weight)
    return total


def _best_windows(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the largest sum of a window, and the symbols of that window."""
    best = np.zeros(len(texts))
    windows = np.zeros((len(texts), _REACH), dtype=np.int32)
    i = 0
    gap = np.zeros(_REACH, dtype=np.int32)
    while i < len(texts):
        parts, starts, size, first = [], [], 0, i
        while i < len(texts) and (not parts or size < _CHUNK):
            symbols = fold(texts[i])
            starts.append(size)
            parts += [symbols, gap]
            size += len(symbols) + len(gap)
            i += 1
        joined = np.concatenate(parts)
        total = np.concatenate(([0.0], np.cumsum(_sums(joined, weights), dtype=np.float64)))
        window = total[_WINDOW:] - total[:-_WINDOW]
        top = np.maximum.reduceat(window, starts)
        best[first:i] = top
        stops = [*starts[1:], len(window)]
        for k, (a, b) in enumerate(zip(starts, stops)):
            at = a + int(window[a:b].argmax())
            windows[first + k] = joined[at : at + _REACH]
    return best, windows


def _random_windows(texts: list[str], rng: np.random.Generator, per_text: int = 2) -> np.ndarray:
    found = []
    for text in texts:
        symbols = np.concatenate((fold(text), np.zeros(_REACH, dtype=np.int32)))
        for at in rng.integers(0, len(symbols) - _REACH + 1, per_text):
            found.append(symbols[at : at + _REACH])
    return np.array(found, dtype=np.int32).reshape(-1, _REACH)


def _kernel(windows: np.ndarray, row_of: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Kernel of each window with each landmark."""
    found = np.zeros((len(windows), matrix.shape[1]))
    for at in range(0, len(windows), 256):
        part = windows[at : at + 256]
        for a, b, c, weight in _steps():
            for i in range(_WINDOW):
                u = part[:, i] << 15 | part[:, i + a] << 10 | part[:, i + b] << 5 | part[:, i + c]
                found[at : at + 256] += matrix[row_of[u]] * weight
    return found


def _table(sequences: np.ndarray, matrix: np.ndarray, share: np.ndarray) -> np.ndarray:
    """One weight per sequence from the share of each landmark."""
    weights = np.zeros(1 << 20, dtype=np.float32)
    weights[sequences] = (matrix[:-1] @ share).astype(np.float32)
    return weights


def _machine(z: np.ndarray, y: np.ndarray, cost: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps; both labels weigh alike."""
    x = np.hstack((z, np.ones((len(z), 1))))
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ w))
        active = short > 0
        scaled = x[active] * weight[active, None]
        gradient = ridge @ w - 2 * cost * (scaled * (y * short)[active, None]).sum(axis=0)
        step = np.linalg.solve(ridge + 2 * cost * scaled.T @ x[active], gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _probability(best: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the labels, by damped Newton steps."""
    scale = max(float(best.std()), 1e-9)
    x = np.stack((best / scale, np.ones(len(best))), axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - label)) + 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0] / scale), float(w[1])
