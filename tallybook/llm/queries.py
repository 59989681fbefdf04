"""The named queries over the corpus tables, and the SQL for those that SQL can express.

Each applies its operator with production parameters to a whole table and derives from the
operator's own output the columns to compare.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.llm import (
    bpe,
    filter_audit,
    fingerprints,
    jaccard_join,
    language,
    merkle,
    packing,
    pii,
    simhash_dedup,
    suffix_dedup,
    topk,
    toxicity,
    url_rules,
)
from tallybook.llm.common import held_out, prepare

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
SKETCH = 128

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def vocabulary(name: str) -> bytes:
    """Content of a tokenizer file: a path, or a name the installed tokenizer files have."""
    if not Path(name).exists():
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Path(name).read_bytes()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, model, keep_text=False).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep_text=False).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str = WORD_VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, vocabulary(path), keep_text=False).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fingerprints.edited_fingerprints(docs, k=SKETCH)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        _hex(F.col("sketch")).alias("fingerprint"),
        _hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _hex(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup.simhash_groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op7_packing(spark: SparkSession, sf_dir: str, path: str = BYTE_VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary(path), keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs, ~held_out(F.col("doc_id")))
    return language.identify_languages(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = pii.KINDS[:4]
    kinds = F.transform(spans, lambda x: x["kind"])
    counts = [(F.size(spans) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return pii.find_personal_data(docs, keep_text=False).select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.filter(spans, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit_text_filters(docs, table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = merkle.digest_of(*fields, F.col("text"))
    leaves = docs.select(
        "doc_id", "lang", own.alias("digest"), F.when(tampered, merkle.digest_of(*fields, lowered)).alias("tampered")
    )
    proofs = merkle.manifest(leaves, "lang", "doc_id", "digest").proofs
    folded = merkle.folded(F.coalesce("tampered", "digest"), F.col("path"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_of(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_bpe,
        op4_url_rules,
        op5_fingerprints,
        op6_simhash,
        op7_packing,
        op8_language,
        op9_topk,
        op10_pii,
        op11_filter_audit,
        op12_merkle,
        op13_jaccard,
    )
}

_OP4 = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), named AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES {rules}
), fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (
      PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC
    ) AS place
  FROM named JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM named n LEFT JOIN fitting f ON n.page_id = f.page_id AND f.place = 1
"""

_OP9 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP11 = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), {words}) AS w
  FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), marked AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM texts
), classes AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, fails
), letters(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), ranked AS (
  SELECT part, filter_order, fails, n, good, toxic,
    (SELECT min(position(x IN filter_order)) FROM letters WHERE contains(fails, x)) AS gone
  FROM classes CROSS JOIN orders
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, substring(filter_order, step, 1) AS letter,
    coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0) AS kept,
    coalesce(sum(n) FILTER (gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone < step AND contains(fails, substring(filter_order, step, 1))), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = substring(filter_order, step, 1)), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM ranked CROSS JOIN range(1, 6) AS steps(step)
  GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""

_OP12 = """
WITH RECURSIVE told AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS UBIGINT),
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
        lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))
    ), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS tampered
  FROM told
), placed AS (
  SELECT doc_id, leaf, coalesce(tampered, leaf) AS given, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), low(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM low WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (
  SELECT tree, digest FROM low WHERE n = 1
), high(level, pos, digest, n) AS (
  SELECT 0, tree, digest, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM high WHERE n > 1 GROUP BY level, pos // 8, n
), siblings AS (
  SELECT p.tree, p.pos, u.level AS step, u.digest, u.pos AS place, u.pos - (p.pos >> (3 * u.level)) AS side
  FROM placed p JOIN low u ON u.tree = p.tree AND u.n > 1 AND u.pos >> 3 = p.pos >> (3 * u.level + 3)
  UNION ALL
  SELECT p.tree, p.pos, 100 + u.level, u.digest, u.pos, u.pos - (p.tree >> (3 * u.level))
  FROM placed p JOIN high u ON u.n > 1 AND u.pos >> 3 = p.tree >> (3 * u.level + 3)
), steps AS (
  SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY step) AS k,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (side < 0), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (side > 0), '') AS after
  FROM siblings GROUP BY tree, pos, step
), proofs AS (
  SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY tree, pos
), climbed(tree, pos, k, digest) AS (
  SELECT tree, pos, 0, given FROM placed
  UNION ALL
  SELECT c.tree, c.pos, c.k + 1, sha256(s.before || c.digest || s.after)
  FROM climbed c JOIN steps s ON s.tree = c.tree AND s.pos = c.pos AND s.k = c.k + 1
), folded AS (
  SELECT tree, pos, arg_max(digest, k) AS folded_root FROM climbed GROUP BY tree, pos
), top AS (
  SELECT digest AS root FROM high WHERE n = 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, c.folded_root,
  c.folded_root = t.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded c USING (tree, pos) LEFT JOIN proofs f USING (tree, pos) CROSS JOIN top t
"""

_OP13 = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {words}) AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM texts
), classes AS (
  SELECT row_number() OVER () AS class, s, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s
), held AS (
  SELECT class, n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT a.class AS a, b.class AS b
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.class <> b.class
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached(a, b) AS (
  SELECT class, class FROM classes
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), components AS (
  SELECT r.a AS class, min(c.first) AS component_id FROM reached r JOIN classes c ON c.class = r.b GROUP BY r.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE m.component_id END AS component_id
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN components m ON m.class = c.class
"""

SQL: dict[str, str] = {
    "op4_url_rules": _OP4.format(rules=", ".join(str(r) for r in URL_RULES)),
    "op9_topk": _OP9,
    "op11_filter_audit": _OP11.format(words=_WORDS),
    "op12_merkle": _OP12,
    "op13_jaccard": _OP13.format(words=_WORDS),
}
