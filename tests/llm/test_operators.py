"""Each corpus operator against a brute-force version, and over rows that are out of line."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import (
    bpe,
    fingerprints,
    language,
    packing,
    pii,
    queries,
    simhash_dedup,
    suffix_dedup,
    topk,
    toxicity,
    url_rules,
)
from tallybook.llm.common import held_out
from tallybook.llm.suffix_array import permuted_common_prefixes, suffix_array

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
ROOT = str(Path(__file__).parents[2])
ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Sketch int, kept string, rest string, id string, `a.b` string"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    words = [f"w{i * 7919 % 1000}" for i in range(9000)]
    texts = [
        None, "", " ", "\n\t", "word", "one two three four five six", "one two three four five six",
        " ".join(words), " ".join(words), " ".join(words[50:]), "é" * 300, "a" * 1000, "\U0001f600 " * 50,
        "x@y.zz +12 345 678 901 4111 1111 1111 1111 1.2.3.4", "\x00\x01 \x7f", "ß" + "Σ" * 3,
    ]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1, "k", None, "i", "q") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[6], (3, "another text of the same id", None, "s", 5, None, None, "r", None, None)]
    rows += [(None, t, None, None, None, None, None, None, None, None) for t in (None, "", "no id here", "no id here", " ".join(words[:99]))]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def untouched(found, given):
    """Columns of the input come back as they were, but for those the operator replaces."""
    kept = [c for c in given.columns if c in found.columns and c not in ("kept",)]
    count = lambda df: Counter(tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in kept]).collect())
    assert count(found) == count(given)


# Suffix arrays


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(150):
        x = rng.integers(0, rng.integers(1, 6), rng.integers(1, 250))
        x = np.tile(x[: 1 + trial % 9], 40)[: len(x)] if trial % 3 == 0 else x
        content = bytes((x + 1).tolist())
        order = suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: content[i:])
        shared = permuted_common_prefixes(x + 1, order, 12)
        for a, b in zip(order, order[1:]):
            same = next((i for i in range(12) if content[a + i : a + i + 1] != content[b + i : b + i + 1] or b + i >= len(x)), 12)
            assert shared[b] == same


def repeats(rows, length):
    """Per row: size, removed bytes, runs, hash of what stays. Equal rows are one document."""
    seen, found = set(), {}
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for i, text, h in sorted({(i, t, h) for i, t, h in rows}, key=key):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        found[i, text] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return found


@pytest.mark.parametrize("name", ["small", "odd"])
@pytest.mark.parametrize("options", [{}, {"length": 40, "anchor": 9, "shard_bytes": 2000, "hot_anchors": 10**6}])
def test_repeats_equal_brute_force(request, name, options):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    want = repeats(rows, options.get("length", 100))
    found = suffix_dedup.remove_repeats(df, **options)
    digest = F.struct("n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256))
    got = found.select("doc_id", "text", digest).collect()
    assert len(got) == len(rows)
    assert all(tuple(r[2]) == want[r[0], r[1]] for r in got)
    untouched(found, df)


def test_repeats_of_nothing_and_cut_characters(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    body = "".join(f"é{i}" for i in range(60))
    df = spark.createDataFrame([(1, "aé" + body), (2, "bé" + body)], "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(df, as_text=True).collect()}
    assert kept == {1: "aé" + body, 2: "b"}


# SimHash


def fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("name", ["small", "odd"])
@pytest.mark.parametrize("options", [{}, {"leaf": 8, "block": 16}])
def test_simhash_groups_equal_brute_force(request, name, options):
    df = request.getfixturevalue(name)
    rows = texts_of(df)
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            root[top(a)] = top(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[top(k)] += [] if i is None else [i]
    want = Counter((i, prints[k], min(ids[top(k)], default=None)) for k, (i, _) in enumerate(rows))
    found = simhash_dedup.simhash_groups(df, **options)
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in found.collect()) == want
    groups = {top(k) for k in range(len(rows))}
    assert simhash_dedup.one_of_each(found).count() == len(groups)


def test_simhash_links_across_many_leaves(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    flips = rng.integers(0, 64, (1500, 4))
    near = base ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate((base, near))).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in prints], "fp bigint")
    found = {r.node: r.root for r in simhash_dedup.linked(df, 4, 3, 32, 64).collect()}
    for a, b in zip(base.view(np.int64).tolist(), near.view(np.int64).tolist()):
        assert found.get(a, a) == found.get(b, b)


def test_trees_grown_below_a_shard_miss_no_pair():
    rng = np.random.default_rng(5)
    mask = np.uint64((1 << 21) - 1)
    same = rng.integers(0, 1 << 40, 300, dtype=np.uint64) << np.uint64(21) | np.uint64(77)
    own = np.concatenate((rng.integers(0, 1 << 64, 2000, dtype=np.uint64), same))
    asking = np.concatenate((own[::7] ^ np.uint64(1 << 3), own[::11]))
    tree = simhash_dedup._grown(own, mask, 16)
    met, compared = set(), 0
    for places, at in simhash_dedup._reached(tree, asking, mask, 1):
        assert len(places) <= 16 or len(np.unique(own[places] & mask)) == 1
        close = np.bitwise_count((asking[at][:, None] ^ own[places][None, :]) & mask) <= 1
        met |= {(int(at[q]), int(places[x])) for q, x in zip(*np.nonzero(close))}
        compared += len(places) * len(at)
    close = np.bitwise_count((asking[:, None] ^ own[None, :]) & mask) <= 1
    assert met == {(int(q), int(x)) for q, x in zip(*np.nonzero(close))}
    assert compared < len(own) * len(asking) / 2


@pytest.mark.parametrize("prints", [[5] * 40, [5], [], [1, 2, 4, 8, 0]])
def test_grown_trees_end_on_equal_fingerprints(prints):
    own = np.array(prints, dtype=np.uint64)
    tree = simhash_dedup._grown(own, np.uint64(0xFF), 2)
    found = [p for places, _ in simhash_dedup._reached(tree, own[:1], np.uint64(0xFF), 64) for p in places.tolist()]
    assert sorted(found) == (list(range(len(own))) if prints else [])


@pytest.mark.parametrize("block", [64, 1 << 15])
def test_simhash_links_in_crowded_leaves(spark, block, monkeypatch):
    plant = simhash_dedup._plant
    monkeypatch.setattr(simhash_dedup, "_plant", lambda nodes, bits, bands, leaf: plant(nodes, bits, bands, leaf, max_depth=1))
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
    near = base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64), axis=1)
    prints = np.unique(np.concatenate((base, near, np.arange(50, dtype=np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    found = {r.node: r.root for r in simhash_dedup.linked(df, 4, 3, 16, block).collect()}
    root = {int(x): int(x) for x in prints.view(np.int64)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    q, x = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    for a, b in zip(prints[q].view(np.int64).tolist(), prints[x].view(np.int64).tolist()):
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert found == {x: top(x) for x in root if top(x) != x}


def test_simhash_of_nothing(none):
    assert simhash_dedup.simhash_groups(none).count() == 0


def test_connected_follows_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash_dedup.connected(links).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 501: 500}


# Byte-pair encoding


@pytest.mark.parametrize("name", ["small", "odd"])
def test_bpe_equals_the_library(request, name):
    df = request.getfixturevalue(name)
    vocabulary = queries.vocabulary(queries.WORD_VOCABULARY)
    library = Tokenizer.from_str(vocabulary.decode())
    found = bpe.encode_texts(df, vocabulary)
    for r in found.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    untouched(found, df)


def test_bpe_of_odd_characters():
    vocabulary = queries.vocabulary(queries.WORD_VOCABULARY)
    library, coder = Tokenizer.from_str(vocabulary.decode()), bpe.Coder(vocabulary, held=50)
    rng = np.random.default_rng(4)
    pool = list("abcdefgthingerABCÉéñüßΣσς'!?.,;  \n\t\x1c\x85\u20030189日本한🙂\u0301İǅ½²Ⅷ<|>") + ["<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(pool, rng.integers(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        found, decoded = coder.both(text)
        assert np.frombuffer(found, dtype="<u4").tolist() == ids, text
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_packing_encodes_as_the_library():
    vocabulary = queries.vocabulary(queries.BYTE_VOCABULARY)
    library, encode = Tokenizer.from_str(vocabulary.decode()), packing._encoder(vocabulary)
    rng = np.random.default_rng(4)
    pool = list("abcdefgtheing' ABC\u00c9\u00e9\u00df'!?.,;    \n\t\r\x1c\x85\xa0\u2003018\xb2\xbd\xaa\u65e5\U0001f642\x00\x7f") + ["<|endoftext|>", "'s", "'LL"]
    texts = ["".join(rng.choice(pool[:-5] if k % 2 else pool, rng.integers(0, 30))) for k in range(3000)]
    for text in [*texts, "a" * 5000, " " * 3000, "", "x" * 900 + "!" * 900]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == ids, text


# URL rules


def judged(rows, rules, default="allow"):
    found = []
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
        found.append((i, host, path, best and best[0] + best[1], best[2] if best else default))
    return Counter(found)


def test_url_rules_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "b.a.example.org", "com", "x.com", "", "org.", "a..org", "A.Example.ORG", "a\x01b.org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/12/3", "/es/", "/fr/x?q", "/de/#f", "?q", "/en/1\n2"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/", "https://org/en/1"] * 2
    pages = [(i if i % 11 else None, u) for i, u in enumerate(urls)] + [(900 + i, "http://example.org/en/1") for i in range(300)]
    rules = {(str(rng.choice(hosts[:7])), str(rng.choice(paths[1:7]))): str(rng.choice(["allow", "block"])) for _ in range(25)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    for chosen in (rules, queries.URL_RULES, []):
        given = spark.createDataFrame(chosen + [(None, "/", "block")], "host string, path string, verdict string")
        df = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id bigint, url string, HOST string, rest string")
        found = url_rules.judge_urls(df, given, default="block")
        got = Counter(tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict").collect())
        assert got == judged(pages, chosen, "block")
        assert found.columns == ["page_id", "url", "rest", "host", "path", "rule", "verdict"]
    assert url_rules.judge_urls(df.limit(0), given).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_corpus_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, MEDIUM), MEDIUM, queries.SQL[name]) is None


# Fingerprints


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("name", ["small", "odd"])
def test_edited_fingerprints_equal_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = Counter()
    near = defaultdict(list)
    for (i, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        key = (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        want[key] += 1
        near[key].append((likeness(shingles(text), shingles(edited)), likeness(shingles(text), shingles(after))))
    found = fingerprints.edited_fingerprints(df, sample_per_part=3).collect()
    assert Counter((r.id, r.n_chars, r.edited_sha256) for r in found) == want
    for r in found:
        key = (r.id, r.n_chars, r.edited_sha256)
        assert any(abs(r.near_edited - e) < 0.2 and abs(r.near_next - n) < 0.2 for e, n in near[key])


def test_fingerprints_merge_and_compare(spark, odd, none):
    found = fingerprints.fingerprint_documents(odd, k=64).collect()
    by_text = defaultdict(set)
    for r in found:
        by_text[r.text or ""].add(tuple(r.sketch))
        if len(shingles(r.text)) < 64:
            assert r.n_shingles == len(shingles(r.text))
    assert all(len(v) == 1 for v in by_text.values()) and by_text[""] == {()}
    assert fingerprints.fingerprint_documents(none).count() == 0
    words = [str(i) for i in range(4000)]
    parts = [("x", " ".join(words[:2100])), ("x", " ".join(words[2000:])), ("y", " ".join(words[:1000]))]
    df = spark.createDataFrame(parts, "part string, text string")
    sketches = fingerprints.fingerprint_documents(df, k=512, id_col="part")
    merged = fingerprints.merge_sketches(sketches, ["part"], 512).groupBy().pivot("part", ["x", "y"]).agg(F.first("sketch"))
    near, inside, size = merged.select(
        fingerprints.resemblance(F.col("x"), F.col("y"), 512),
        fingerprints.containment(F.col("y"), F.col("x"), 512),
        fingerprints.distinct_shingles(F.col("x"), 512),
    ).first()
    assert abs(near - 0.25) < 0.08 and inside > 0.8 and abs(size / 3996 - 1) < 0.2


# Packing


@pytest.mark.parametrize("name", ["small", "odd"])
def test_packing_places_every_id_once(request, name):
    df = request.getfixturevalue(name)
    vocabulary = queries.vocabulary(queries.BYTE_VOCABULARY)
    library = Tokenizer.from_str(vocabulary.decode())
    pieces = packing.pack_documents(df, vocabulary, window=64).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts_of(df))
    by_id = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        by_id[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for (i, ids), count in want.items():
        own = [p for p in by_id[i] if p.doc_tokens == len(ids)]
        assert sum(p.length for p in own) >= len(ids) * count
        for p in own:
            if sum(1 for j, x in want if j == i and len(x) == len(ids)) == 1:
                assert np.frombuffer(p.ids, dtype="<u4").tolist() == list(ids[p.start : p.start + p.length])
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = 0
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(p.length for p in pieces)


def test_packing_fills_sequences_with_short_texts(spark):
    """Neither a number of segments nor the window ends a sequence that short texts could go on."""
    docs = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(9000)], "doc_id bigint, text string").coalesce(1)
    pieces = packing.pack_documents(docs, queries.vocabulary(queries.BYTE_VOCABULARY)).collect()
    assert {p.doc_id for p in pieces} == set(range(9000))
    size = Counter()
    for p in pieces:
        size[p.sequence_id] += p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in size.values()), size
    assert sum(n < 2048 for n in size.values()) <= 11 and sum(size.values()) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_packing_examples_keeps_all_limits(spark, none):
    rng = np.random.default_rng(8)
    rows = [(i, int(t), int(s), int(t * q)) for i, (t, s, q) in enumerate(zip(rng.integers(0, 900, 700), rng.integers(1, 7, 700), rng.random(700)))]
    rows += [(9000, 5000, 1, 10), (9001, None, None, None)]
    df = spark.createDataFrame(rows, "example_id bigint, n_tokens bigint, n_segments bigint, n_loss bigint").coalesce(2)
    limits = packing.Limits(tokens=1024, segments=12, loss_tokens=600)
    found = packing.pack_examples(df, limits, window=128).collect()
    demand = {r[0]: [x or 0 for x in r[1:]] for r in rows}
    assert Counter(r.example_id for r in found) == Counter(list(demand))
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, *demand[r.example_id], r.example_id))
    for own in held.values():
        tokens, segments, loss = (sum(x[k] for x in own) for k in (1, 2, 3))
        assert len(own) == 1 or (tokens <= 1024 and segments <= 12 and loss <= 600)
        at = 0
        for offset, size, *_ in sorted(own):
            assert offset <= at
            at = max(at, offset + size)
    assert len(held) < 1.3 * max(sum(d[k] for d in demand.values()) / m for k, m in ((0, 1024), (1, 12), (2, 600)))
    assert packing.pack_documents(none, queries.vocabulary(queries.BYTE_VOCABULARY)).count() == 0


# Language


def test_language_of_held_out_documents(spark, odd, none):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    learn = ~held_out(F.col("doc_id"))
    model = language.fit_languages(docs, learn)
    found = language.identify_languages(docs, model).where(~learn).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    again = language.identify_languages(odd, model)
    for r in again.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    untouched(again, odd)
    nothing = language.fit_languages(none, learn)
    assert {r.lang_pred for r in language.identify_languages(odd, nothing).collect()} == {"und"}


def test_language_rejects_the_share_asked_for(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for share in (0.02, 0.1):
        model = language.fit_languages(docs, F.lit(True), rejected=share, rows_per_language=4096)
        found = language.identify_languages(docs.where("text IS NOT NULL AND lang IS NOT NULL"), model).collect()
        gone = sum(r.rejected for r in found) / len(found)
        assert 0.5 * share <= gone <= 2 * share, (share, gone)


def test_language_left_out_is_rejected_more_often(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        model = language.fit_languages(docs, F.col("lang") != lang)
        found = language.identify_languages(docs, model).groupBy((F.col("lang") == lang).alias("foreign")).agg(F.avg(F.col("rejected").cast("int")).alias("gone"))
        gone = {r.foreign: r.gone for r in found.collect()}
        print("left out", lang, gone)
        assert gone[True] > 0.5 and gone[False] < 0.02, (lang, gone)


# Top-k


def test_top_inner_products_leave_far_cells_out(spark):
    """Clusters far apart, a dimension that a small sample may lack: exact, and few cells are asked."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-40, 40, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.5, 16)).tolist()) for i in range(1200)]
    rows += [(5000 + 50 * i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        scores = [(-int(v @ whole[q]), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:5], 1)]
    for sample in (400, 60):
        found = topk.top_inner_products(df, shard_rows=60, pivots=12, pivot_sample=sample)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    table = topk._pivots([whole[i].tolist() for i in range(1200)], 12)
    vectors = [whole[i].tolist() for i in range(1200)]
    placed = list(topk._place(table)([_vector_batch(range(1200), vectors)]))[0].to_pandas()
    cells = [(c, 1, g.away.min(), g.away.max(), g.square.max()) for c, g in placed.groupby("cell")]
    asking = [i for i in range(1200) if i % 50 == 0]
    known = {16: (np.arange(1200), np.array(vectors, dtype=np.float64))}
    run = topk._visits(table, cells, {c[0]: n for n, c in enumerate(cells)}, known, 5)
    visits = sum(len(b) for b in run([_vector_batch(asking, [vectors[i] for i in asking])]))
    assert visits < len(asking) * len(cells) / 2


def _vector_batch(ids, vectors):
    columns = [pa.array(list(ids), pa.int64()), pa.array(vectors, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["id", "v"])


def test_top_inner_products_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)] + [(50, rows[50][1]), (None, rows[1][1]), (2000, None), (2050, [1.0, float("nan")]), (2100, [None, 1.0]), (2150, [float("inf")] * 6), (2200, []), (2250, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, a in ints.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints.items() if i != q and len(b) == len(a))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    found = topk.top_inner_products(df, shard_rows=100, pivots=8)
    assert {tuple(r) for r in found.collect()} == want
    assert topk.top_inner_products(df.limit(0)).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in re.sub("[^0-9]", "", text)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = len(re.sub("[^0-9]", "", m.group()))
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 14 <= digits <= 19 and luhn(m.group()))
                or (kind == "phone" and 10 <= digits <= 15)
            ):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("name", ["small", "odd"])
def test_personal_data_equals_patterns(request, name):
    df = request.getfixturevalue(name)
    found = pii.find_personal_data(df)
    for r in found.collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert [s for s in spans if s[0] in pii.KINDS[:4]] == base_spans(r.text or "")
        assert (r.masked is None) == (r.text is None)
    untouched(found, df)


def test_personal_data_of_random_strings():
    rng = np.random.default_rng(10)
    pools = [list("12 34-.56+()"), list("ab@.c-_@."), list("1.25.0 9"), list("+1 (2) 3-4.5a")]
    anchors = pii._anchors()
    for k in range(6000):
        text = "".join(rng.choice(pools[k % 4], rng.integers(0, 40)))
        spans = [s for s in pii.spans_of(text, anchors) if s[0] in pii.KINDS[:4]]
        assert spans == base_spans(text), text


def test_personal_data_the_method_adds():
    anchors = pii._anchors()
    text = "See https://bob:pw@host.org/x, IBAN: GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789; account no, account 12345678."
    kinds = {k: text[s:e] for k, s, e in pii.spans_of(text, anchors)}
    assert kinds["url"] == "https://bob:pw@host.org/x" and kinds["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert kinds["ssn"] == "123-45-6789" and kinds["account"] == "12345678"
    assert pii.mask("a x@y.zz b", [("email", 2, 8)]) == "a [EMAIL] b"


IDENTIFIERS = [
    ("account", "Account number: {}", "12345678"),
    ("account", "account no. {}", "12345678"),
    ("account", "ACCOUNT NO {}.", "12345678"),
    ("account", "aCCount: {}", "1234 5678 90"),
    ("account", "account_number={}", "12345678"),
    ("account", '{{"accountNumber": "{}"}}', "12345678"),
    ("account", "my bank account is {}", "12345678"),
    ("account", "Kontonummer {}", "12345678"),
    ("account", "Kontonummer lautet: {}", "12345678"),
    ("account", "KONTONR. {}", "12345678"),
    ("account", "Konto-Nr.: {}", "12345678"),
    ("account", "Bankkonto Nr. {}", "12345678"),
    ("account", "Kto. {}", "12345678"),
    ("account", "numéro de compte : {}", "12345678"),
    ("account", "Compte bancaire n° {}", "12345678"),
    ("account", "COMPTE NUMÉRO {}", "12345678"),
    ("account", "número de cuenta: {}", "12345678"),
    ("account", "La cuenta bancaria es la {}", "12345678"),
    ("account", "Cuenta N.º {}", "12345678"),
    ("ssn", "SSN is {}", "123-45-6789"),
    ("ssn", "Social Security Number: {}", "123-45-6789"),
    ("ssn", "Ssn no. {}", "123456789"),
    ("iban", "IBAN number is {}", "GB82 WEST 1234 5698 7654 32"),
    ("iban", "iBan lautet {}", "DE89370400440532013000"),
    ("iban", "IBAN: {}", "NO9386011117947"),
    ("iban", "el IBAN es {}", "ES9121000418450200051332"),
    ("account", "\u0130\u0130 account number {}", "12345678"),
]


@pytest.mark.parametrize("kind, form, number", IDENTIFIERS)
def test_identifiers_in_usual_forms(kind, form, number):
    text = form.format(number)
    assert [(k, text[s:e]) for k, s, e in pii.spans_of(text, pii._anchors()) if k == kind] == [(kind, number)]


@pytest.mark.parametrize(
    "text", ["accountant 12345678", "le décompte 12345678", "account since 12345678", "Kontor 12345678", "SSN is 1234", "IBAN number GB83 WEST 1234 5698 7654 32", "Oktober 12345678", "account number is"]
)
def test_no_identifier_is_announced(text):
    assert not [x for x in pii.spans_of(text, pii._anchors()) if x[0] in pii.KINDS[5:]]



# Toxicity


def test_toxicity_of_held_out_documents(spark, odd, none):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    unseen = docs.join(labels.where(held_out(F.col("doc_id"))), "doc_id")
    scored = toxicity.score_toxicity(unseen, model).collect()
    toxic = np.array([r.toxicity for r in scored if r.toxic == 1])
    clean = np.array([r.toxicity for r in scored if r.toxic == 0])
    caught, flagged = (toxic >= 0.5).mean(), (clean >= 0.5).mean()
    assert caught > 0.8 and flagged < 0.02
    given = spark.createDataFrame(enumerate(["such an idiot here", "such an i-d-i-o-t here", "such an i d i o t here", "such an 1diot here", "such an idi*ot here", "such a house here", "", None]), "doc_id bigint, text string")
    score = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(given, model).collect()}
    assert min(score[i] for i in range(5)) > 0.5, score
    assert max(score[i] for i in range(5, 8)) < 0.2, score
    untouched(toxicity.score_toxicity(odd, model), odd)
    unlearned = toxicity.fit_toxicity(none, labels, ~held_out(F.col("doc_id")))
    assert toxicity.score_toxicity(odd, unlearned).agg(F.max("toxicity")).first()[0] < 0.5


def test_every_character_is_split_as_the_library_does():
    """Each code point between two letters, in one text for a run of them."""
    vocabulary = queries.vocabulary(queries.WORD_VOCABULARY)
    coder, library = bpe.Coder(vocabulary), Tokenizer.from_str(vocabulary.decode())
    points = [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]
    texts = [" ".join(f"a{chr(p)}b" for p in points[i : i + 256]) for i in range(0, len(points), 256)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(coder.both(text)[0], dtype="<u4").tolist() == want.ids, text


def test_addresses_in_linear_time():
    """A text of a million characters of schemes, each with a user and a host."""
    text = "http://u@h/" * 90_000
    found = [x for x in pii.spans_of(text, pii._anchors()) if x[0] == "url"]
    assert len(found) == 90_000 and found[0] == ("url", 0, len(text)) and found[-1] == ("url", len(text) - 11, len(text))
    odd = "see http://u@h, ftp://x:y@z/http://!!! and http://a/b@c https://@h http://u@h?q).,"
    assert [odd[s:e] for k, s, e in pii.spans_of(odd, pii._anchors()) if k == "url"] == [
        "http://u@h", "ftp://x:y@z/http://", "http://u@h?q",
    ]


@pytest.mark.parametrize("length, anchor", [(300, 20), (1000, 30)])
def test_long_strings_are_removed(spark, length, anchor):
    rng = np.random.default_rng(length)
    passages = ["".join(rng.choice(list("abcdefgh "), 2 * length)) for _ in range(3)]
    texts = []
    for _ in range(40):
        text = "".join(rng.choice(list("abcdefgh "), int(rng.integers(1, 3 * length))))
        some = passages[rng.integers(3)]
        begin = int(rng.integers(0, length))
        at = int(rng.integers(0, len(text)))
        texts.append(text[:at] + some[begin : begin + int(rng.integers(length // 2, 2 * length))] + text[at:])
    rows = [(i, t) for i, t in enumerate(texts)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=length, anchor=anchor)
    got = {r.doc_id: r.kept.decode() if isinstance(r.kept, (bytes, bytearray)) else r.kept for r in found.collect()}
    seen, want = set(), {}
    for i, text in rows:
        covered = bytearray(len(text))
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            if window in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(window)
        want[i] = "".join(c for c, gone in zip(text, covered) if not gone)
    assert sum(map(len, want.values())) < sum(map(len, texts))
    assert got == want
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=1 << 17, anchor=20)


def test_queries_run_away_from_the_folder(tmp_path):
    """The models' queries and the packing query, from another working directory and an unset path."""
    script = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as driver
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
spark = spark.config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in ("op1_toxicity", "op8_language", "op3_bpe", "op11_filter_audit", "op12_merkle", "op13_jaccard"):
    assert driver.queries()[name](spark, {SMALL!r}).count(), name
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
