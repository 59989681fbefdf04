"""The pipeline's stages: what each keeps, and that all of it is packed."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import MEDIUM, base_spans, odd_rows, ODD_SCHEMA, repeats
from tokenizers import Tokenizer

import corpus_pipeline
from tallybook.llm import queries
from tallybook.sources.scratch import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], MEDIUM), name))
    return found


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    labels = stages[0].sparkSession.read.parquet(f"{MEDIUM}/labels.parquet")
    words = "idiot|moron|scum|loser|worthless|pathetic|stupid|disgusting"
    assert stages[1].where(F.col("text").rlike(f"(^| )({words})( |$)")).count() <= 2
    clean = stages[0].join(labels.where("toxic = 0"), "doc_id", "left_semi")
    kept = clean.join(stages[1], "doc_id", "left_semi")
    assert kept.count() >= 0.93 * clean.count()


def test_one_of_each_group_stays(stages):
    from tallybook.llm.simhash_dedup import simhash_groups

    groups = simhash_groups(stages[1]).select("component_id").distinct()
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == {r[0] for r in groups.collect()}


def test_repeats_go(stages):
    rows = [tuple(r) for r in stages[2].select("doc_id", "text", F.xxhash64("text")).collect()]
    want = {i: n - gone for (i, _), (n, gone, _, _) in repeats(rows, 100).items()}
    for r in stages[3].collect():
        assert want[r.doc_id] - 8 <= len(r.text.encode()) <= want[r.doc_id]
        assert r.n_chars == len(r.text)


def test_personal_data_goes(stages):
    assert stages[4].count() == stages[3].count()
    assert not any(s for r in stages[4].collect() for s in base_spans(r.text) if s[0] in ("email", "ip"))


def test_all_that_is_left_is_packed(stages):
    library = Tokenizer.from_str(queries.vocabulary(queries.BYTE_VOCABULARY).decode())
    got = {}
    for p in stages[5].orderBy("doc_id", "start").collect():
        got.setdefault(p.doc_id, []).append(np.frombuffer(p.ids, dtype="<u4"))
    for r in stages[4].collect():
        assert np.concatenate(got[r.doc_id]).tolist() == library.encode(r.text, add_special_tokens=False).ids + [1]


def test_odd_rows_pass(spark):
    docs = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    for docs in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, MEDIUM), name)
        docs.count()


def test_one_row_of_each_group_stays(spark):
    """Rows read in twice, and copies and near copies without ids, leave one row of each group."""
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    long, other = " ".join(words), " ".join(reversed(words))
    near = " ".join(words[:-1] + ["end"])
    ids = [(1, long), (2, near), (7, "a text that is read in twice"), (8, "read in once")]
    nameless = [(None, other), (None, other), (None, other + " end"), (None, "no id here"), (None, "no id here"), (None, None), (None, "")]
    docs = spark.createDataFrame((ids[:3] + nameless) * 2 + ids[3:], "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.without_near_copies(spark, docs, MEDIUM).collect()
    keys = [(r.doc_id, r.text and r.text[:25]) for r in got]
    one_of = [(1, long[:25]), (7, ids[2][1][:25]), (8, "read in once"), (None, other[:25]), (None, "no id here")]
    assert sorted((k for k in keys if k[1]), key=str) == sorted(one_of, key=str)
    assert len(got) == 6 and sum(not r.text for r in got) == 1
