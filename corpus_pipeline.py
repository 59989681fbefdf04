"""From raw documents to packed training sequences: five stages, each over all the one before kept.

``STAGES`` names them in order. A stage takes the session, the documents and the folder of the
tables; all but the last return the columns of ``documents``. ``run`` writes what each stage
returns and reads it again for the next.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook.llm import packing, pii, simhash_dedup, suffix_dedup, toxicity  # noqa: E402
from tallybook.llm.common import held_out, prepare, quoted  # noqa: E402
from tallybook.llm.queries import BYTE_VOCABULARY, table, vocabulary  # noqa: E402
from tallybook.sources.scratch import materialize  # noqa: E402

# Several stages lose no document but change its text; SQL cannot express them.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    return toxicity.score_toxicity(docs, model).where(F.col("toxicity") < 0.5).select(*map(quoted, docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, the one with the smallest id.

    Rows are told apart by a number written beside them, so that of repeated rows, too, one stays.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = simhash_dedup.one_of_each(simhash_dedup.simhash_groups(rows, shingle=4, bits=4, row_col="_row"))
    return rows.join(kept.select(F.col("row").alias("_row")), "_row", "left_semi").select(*map(quoted, docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 100 bytes of an earlier text; broken characters go too."""
    found = suffix_dedup.remove_repeats(docs, as_text=True)
    return _with_text(docs, found, F.col("kept"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _with_text(docs, pii.find_personal_data(docs), F.col("masked"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized documents in pieces that fill sequences of 2048."""
    return packing.pack_documents(docs, vocabulary(BYTE_VOCABULARY))


def _with_text(docs: DataFrame, found: DataFrame, text) -> DataFrame:
    changed = found.withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.select(*map(quoted, docs.columns))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
