"""Helpers the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallybook.session import configure

# Rows and bytes Arrow hands to a Python worker at once; documents can be long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Drop the shuffle files of a finished job; what later jobs need is a written table.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings of this package to a session."""
    configure(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: Column) -> DataFrame:
    """Deal rows out by ``keys`` if the input has too few files to keep all cores busy.

    A corpus in many files is read in place; a few large files would leave most cores idle.
    """
    files = len(df.inputFiles())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(F.xxhash64(*keys)) if 0 < files < 4 * cores else df


def others(df: DataFrame, taken: Iterable[str]) -> list[str]:
    """Columns of ``df`` that no result column replaces; names compare without case."""
    names = {name.lower() for name in taken}
    return [name for name in df.columns if name.lower() not in names]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def rest(df: DataFrame, taken: Iterable[str]) -> Column:
    """The other columns as one struct, so that no name can clash on the way through an operator."""
    kept = others(df, taken)
    return F.struct(*[quoted(n).alias(n) for n in kept]) if kept else F.struct(F.lit(None).alias("_"))


def carried(docs: DataFrame, id_col: str, text_col: str, results: Iterable[str]) -> DataFrame:
    """``id``, ``text`` and all other columns as ``rest``; the text travels once."""
    return docs.select(
        quoted(id_col).alias("id"),
        quoted(text_col).cast("string").alias("text"),
        rest(docs, [*results, text_col]).alias("rest"),
    )


def passed(rows: pa.RecordBatch, keep_text: bool, **results: pa.Array) -> pa.RecordBatch:
    """A batch of carried columns with results added."""
    columns = {"rest": rows.column("rest")} | ({"text": rows.column("text")} if keep_text else {}) | results
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def passed_schema(texts: DataFrame, keep_text: bool, results: str) -> StructType:
    own = [texts.schema["rest"], *([texts.schema["text"]] if keep_text else [])]
    return StructType([*own, *StructType.fromDDL(results)])


def restored(docs: DataFrame, text_col: str, results: Sequence[str], keep_text: bool = True) -> list[Column]:
    """The columns of ``docs`` as they came, and the results; without ``keep_text`` no text."""
    columns = []
    for name in others(docs, results):
        if name.lower() != text_col.lower():
            columns.append(F.col("rest").getField(name).alias(name))
        elif keep_text:
            columns.append(F.col("text").alias(name))
    return [*columns, *[F.col(r) for r in results]]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows no classifier learns from; rows without an id are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def once(key: str, build: Callable):
    """A value built once in each Python worker, however many tasks it runs."""
    store = sys.modules.setdefault("_tallybook_once", types.ModuleType("_tallybook_once"))
    if not hasattr(store, key):
        setattr(store, key, build())
    return getattr(store, key)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row starts in them (one more than rows); null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1]
    start = start.astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), start - start[0]
    content = np.frombuffer(data, dtype=np.uint8)[start[0] : start[-1]]
    return content, start - start[0]


def batch(schema: pa.Schema, *columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)],
        schema=schema,
    )
