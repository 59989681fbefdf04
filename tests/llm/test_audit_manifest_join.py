"""Filter audit, Merkle manifest and Jaccard join against brute force, and over rows out of line."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from compare import sql_rows
from pyspark.sql import functions as F
from test_operators import ODD_SCHEMA, odd_rows

from tallybook.llm import filter_audit, jaccard_join, merkle, queries

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def tables(folder, spark, docs, labels=()):
    """A folder of tables, as a query reads them."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int")
    found.coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def as_sql(df, where, name):
    """The rows are those of the query's SQL over the tables of the folder."""
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{where}/{table}.parquet/*.parquet')")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    return plain(df.select(*names)) == Counter(found.fetchall())


# Filter audit


def failures(rows):
    """Failed letters of each (doc_id, text)."""
    found = []
    for doc_id, text in rows:
        text = text or ""
        words = text.encode().split()
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        smaller = [i for i, t in rows if i is not None and (t or "") == text and doc_id is not None and i < doc_id]
        fails += "E" * bool(smaller)
        found.append(fails)
    return found


def audited(parts, fails, good, toxic, letters):
    """Walks every order row by row."""
    rows = []
    for part in set(parts):
        own = [i for i, p in enumerate(parts) if p == part]
        shapley = Counter()
        steps = []
        for order in map("".join, permutations(letters)):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in fails[i]]
                redundant = [i for i in own if letter in fails[i] and i not in left]
                left = [i for i in left if letter not in fails[i]]
                shapley[letter] += len(gone)
                alone = sum(fails[i] == letter for i in own)
                steps.append((letter, part, order, step, len(left), len(gone), len(redundant), alone, sum(good[i] for i in gone), sum(toxic[i] for i in gone)))
        rows += [(*s[1:], shapley[s[0]]) for s in steps]
    return Counter(rows)


def test_audit_walks_every_order(spark, odd):
    rows = odd.collect() * 2
    rows += [(90 + i, f"Wörter und WORTE {'x ' * (i * 60)}", "de", None, 1) + rows[0][5:] for i in range(6)]
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    labels = [(3, 1, 0), (3, 0, 1), (5, None, 1), (None, 1, 1), (7, 1, None), (91, 1, 1), (400, 1, 1)]
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    found = filter_audit.audit_text_filters(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    ids = [r[0] for r in rows]
    want = audited(
        [r[2] or "" for r in rows], failures([(r[0], r[1]) for r in rows]),
        [i in good for i in ids], [i in toxic for i in ids], "ABCDE",
    )
    assert plain(found) == want


def test_audit_of_given_filters_and_orders(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b", None]), *[random.choice([True, False, None]) for _ in range(3)]) for _ in range(200)]
    frame = spark.createDataFrame(rows, "part string, X boolean, `y.z` boolean, W boolean").withColumnRenamed("y.z", "Y")
    fails = ["".join(c for c, f in zip("XYW", r[1:]) if f) for r in rows]
    flag = F.col("X") == F.col("W")
    marks = [r[1] is not None and r[1] == r[3] for r in rows]
    found = filter_audit.audit_filters(frame, "XYW", F.col("part"), flag, ~flag)
    against = [r[1] is not None and r[3] is not None and r[1] != r[3] for r in rows]
    want = audited([r[0] or "" for r in rows], fails, marks, against, "XYW")
    assert plain(found) == want
    some = filter_audit.audit_filters(frame, "XYW", F.col("part"), flag, ~flag, orders=["WYX"])
    assert {r.filter_order for r in some.collect()} == {"WYX"}
    for wrong in ("XX", ""):
        with pytest.raises(ValueError):
            filter_audit.audit_filters(frame, wrong, F.col("part"), flag, flag)
    with pytest.raises(ValueError):
        filter_audit.audit_filters(frame, "XYW", F.col("part"), flag, flag, orders=["XY"])


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_text_filters(none, labels).collect() == []


def test_removal_steps_are_the_min_plus_product():
    fails = np.array([[0, 0, 0], [1, 0, 1], [0, 1, 0]], dtype=bool)
    position = filter_audit.position_matrix("ABC", ["ABC", "CBA", "BAC"])
    assert position.tolist() == [[0, 1, 2], [2, 1, 0], [1, 0, 2]]
    assert filter_audit.removal_steps(fails, position).tolist() == [[np.inf] * 3, [0, 0, 1], [1, 1, 0]]


def test_audit_matches_sql_on_odd_rows(spark, odd, folder):
    where = tables(folder, spark, odd, [(3, 1, 0), (3, 0, 1), (None, 1, 1)])
    assert as_sql(queries.op11_filter_audit(spark, where), where, "op11_filter_audit")


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climbed(leaves, arity):
    """Root of a run of leaves and each leaf's (before, after) by level."""
    paths = [[] for _ in leaves]
    held = [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        ups, groups = [], []
        for k in range(0, len(leaves), arity):
            run = leaves[k : k + arity]
            for j in range(len(run)):
                for leaf in held[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(sha("".join(run)))
            groups.append(sum(held[k : k + arity], []))
        leaves, held = ups, groups
    return leaves[0], paths


def proved(rows, arity=8):
    """(doc_id, leaf, subroot, root, proof, folded root of the tampered) by plain recursion."""
    parts = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(told(doc_id, source, lang, n_chars, text))
        given = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            given = sha(told(doc_id, source, lang, n_chars, low))
        parts[lang].append((doc_id is not None, doc_id or 0, leaf, given, doc_id))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    grown = [climbed([r[2] for r in sorted(parts[p])], arity) for p in names]
    root, above = climbed([g[0] for g in grown], arity)
    found = []
    for name, (subroot, paths), rest in zip(names, grown, above):
        for (_, _, leaf, given, doc_id), path in zip(sorted(parts[name]), paths):
            steps = path + rest
            for before, after in steps:
                given = sha(before + given + after)
            proof = sha("".join(a + b for a, b in steps))
            found.append((doc_id, leaf, subroot, root, proof, given, given == root))
    return Counter(found)


def shelf(count, langs, seed=5):
    random.seed(seed)
    names = [None, "", *[f"l{i}" for i in range(langs)], "Z", "é"]
    return [
        (random.choice([None, i, i, i, i // 2]), random.choice([None, "", "Some Text", "plain", f"T{i}"]),
         random.choice(names), random.choice([None, "s"]), random.choice([None, 5]))
        for i in range(count)
    ]


@pytest.mark.parametrize("count, langs", [(1, 0), (60, 1), (500, 150)])
def test_manifest_by_plain_recursion(spark, folder, count, langs):
    rows = shelf(count, langs)
    where = tables(folder, spark, spark.createDataFrame(rows, DOCUMENTS))
    found = queries.op12_merkle(spark, where)
    assert plain(found) == proved(rows)
    assert as_sql(found, where, "op12_merkle")


def test_manifest_of_one_part_and_other_arities(spark):
    rows = [(i, "t", "en", None, i % 3) for i in range(100)]
    leaf = merkle.digest_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumn("digest", leaf).withColumn("Root", F.lit(1))
    for arity in (3, 101):
        done = merkle.manifest(frame, "lang", "doc_id", "digest", arity)
        root, paths = climbed([sha(told(r[0], r[3], r[2], r[4], r[1])) for r in rows], arity)
        assert done.root == root
        own = done.proofs.select("doc_id", "leaf", "subroot", "root", merkle.folded(F.col("digest"), F.col("path")).alias("f"), merkle.proof_of(F.col("path")).alias("p"), F.size("path").alias("n"))
        for r in own.collect():
            assert (r.subroot, r.root, r.f, r.n) == (root, root, root, len(paths[r.doc_id]))
            assert r.p == sha("".join(a + b for a, b in paths[r.doc_id]))
        assert [tuple(r) for r in done.parts.collect()] == [("en", 100, root)]
    with pytest.raises(ValueError):
        merkle.manifest(frame, "lang", "doc_id", "digest", 1)


def test_manifest_of_odd_rows_and_of_nothing(spark, odd, none):
    digest = merkle.digest_of(F.col("doc_id"), F.col("text"))
    done = merkle.manifest(odd.withColumn("leaf", digest), "lang", "doc_id", "leaf")
    assert done.proofs.count() == odd.count()
    assert done.proofs.where(merkle.folded(F.unhex("leaf"), F.col("path")) != F.col("root")).isEmpty()
    kept = [f"`{c}`" for c in odd.columns]
    assert plain(done.proofs.select(kept)) == plain(odd.select(kept))
    nothing = merkle.manifest(none.withColumn("leaf", digest), "lang", "doc_id", "leaf")
    assert nothing.root is None and nothing.proofs.isEmpty() and nothing.parts.isEmpty()


# Jaccard join


def shingles_of(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def grouped(rows, size=3, percent=90):
    sets = [shingles_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[top(i)] = min(doc_id, smallest.get(top(i), doc_id))
    return Counter((d, len(s), smallest.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family(rng, words, size, copies, edits):
    """Copies of one text with up to so many words changed, and chains of changed copies of copies."""
    base = [rng.choice(words) for _ in range(size)]
    made = [base]
    for _ in range(copies):
        own = list(rng.choice(made) if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own = own[: len(own) - rng.randrange(1 + len(own) // 15)]
        made.append(own)
    return [" ".join(m) for m in made]


@pytest.fixture(scope="module")
def families():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size, copies, edits in ((2, 4, 1), (5, 10, 1), (12, 30, 1), (25, 40, 1), (60, 60, 4), (150, 80, 8), (400, 40, 20)):
        texts += family(rng, words, size, copies, edits)
    texts += [" ".join(rng.choice(words[:4]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += ["A b C", "a B c", "a b", "A  B", "a", None, "", " "]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_join_of_families(spark, families):
    frame = spark.createDataFrame(families, "doc_id bigint, text string")
    want = grouped(families)
    assert len({c for _, _, c in want}) < 0.9 * len(families)
    assert plain(jaccard_join.jaccard_groups(frame)) == want
    # Small parts, and a sample of next to nothing.
    assert plain(jaccard_join.jaccard_groups(frame, block=2000, sample=20)) == want


@pytest.mark.parametrize("percent", [60, 97, 100])
def test_join_at_other_thresholds(spark, families, percent):
    frame = spark.createDataFrame(families, "doc_id bigint, text string")
    assert plain(jaccard_join.jaccard_groups(frame, shingle=2, percent=percent)) == grouped(families, 2, percent)


def test_join_finds_the_same_under_any_allocation(spark, families, monkeypatch):
    """Segments at 1 for others at -1, chosen at random in every scheme."""
    frame = spark.createDataFrame(families, "doc_id bigint, text string")
    rng = np.random.default_rng(4)
    first = jaccard_join.bands(90, 500)
    chosen = {}
    for scheme in range(len(first) - 1):
        count = jaccard_join.segments(90, scheme, first)
        given = np.zeros(count, dtype=np.int8)
        given[: count // 2], given[count // 2 : 2 * (count // 2)] = 1, -1
        chosen[scheme] = rng.permutation(given).tobytes()
    monkeypatch.setattr(jaccard_join, "_allocation", lambda *_: chosen)
    assert plain(jaccard_join.jaccard_groups(frame)) == grouped(families)


def test_allocation_swaps_dear_segments_for_cheap_ones():
    at0 = np.array([100.0, 5, 5, 90, 5])
    at1 = np.array([300.0, 10, 60, 200, 12])
    given = jaccard_join.swapped(at0, at1)
    assert given.tolist() == [-1, 1, 0, -1, 1]
    assert not jaccard_join.swapped(np.full(4, 3.0), np.full(4, 40.0)).any()


def test_sampled_allocation_drops_a_frequent_subset(spark):
    """Texts of one common shingle and others that fall into the second of two segments."""
    rng = random.Random(2)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(14)) for _ in range(3000)]
    sampled = spark.createDataFrame([(t,) for t in texts], "text string")
    assert jaccard_join._allocation(sampled, 3, 90, 1.0) == {}
    common = [" ".join(["a b c d e f g h i j k l", *[f"v{rng.randrange(10**6)}"] * 3]) for _ in range(3000)]
    sampled = spark.createDataFrame([(t,) for t in common], "text string")
    chosen = jaccard_join._allocation(sampled, 3, 90, 1.0)
    for given in chosen.values():
        assert np.frombuffer(given, dtype=np.int8).sum() == 0


def test_join_of_odd_rows_and_of_nothing(spark, odd, none, folder):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert plain(jaccard_join.jaccard_groups(odd)) == grouped(rows)
    assert jaccard_join.jaccard_groups(none).collect() == []
    where = tables(folder, spark, odd)
    assert as_sql(queries.op13_jaccard(spark, where), where, "op13_jaccard")
    for wrong in ({"percent": 0}, {"percent": 101}, {"shingle": 0}):
        with pytest.raises(ValueError):
            jaccard_join.jaccard_groups(odd, **wrong)


def test_join_of_given_documents_by_brute_force(spark):
    _, rows = sql_rows(SMALL, "SELECT doc_id, text FROM documents")
    found = queries.op13_jaccard(spark, SMALL).select("doc_id", "n_shingles", "component_id")
    assert plain(found) == grouped(rows)
