"""Bulk inserts, updates and deletes: a frame of changes against a frame of rows.

Tables are values here: every operator returns the table as it is afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallybook.functions.clock import Moment, ts_lit
from tallybook.functions.rows import dense_index
from tallybook.schemas import BLANK_AS_NULL, FILLED, REFERENCES, SCHEMAS, STATED
from tallybook.sources.tables import first_violation, typed_columns


class Inserted(NamedTuple):
    rows: DataFrame  # the table afterwards
    accepted: DataFrame  # the new rows alone, with their ids
    rejected: DataFrame  # rows that did not fit, with reject_reason


class Updated(NamedTuple):
    rows: DataFrame
    unknown_ids: DataFrame  # ids that no row has
    rejected: DataFrame  # changes that did not fit, with reject_reason


def next_id(base: DataFrame) -> int:
    """One above the highest id: a single number fetched from an aggregate."""
    return (base.agg(F.max("id").alias("id")).first()["id"] or 0) + 1


def _is_blank(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.NumericType):
        return value.isNull() | (value == 0)
    return value.isNull()


def insert_rows(
    base: DataFrame,
    new_rows: DataFrame,
    table: str,
    order_by: Sequence[str],
    parents: Mapping[str, DataFrame] | None = None,
    as_of: Moment | None = None,
) -> Inserted:
    """Check, complete, number and append new rows.

    ``order_by`` (ending in a unique column) is the order ids are given in. ``parents`` maps a
    column to the table whose ids it must exist in. ``as_of`` stamps created_at/updated_at.
    """
    kinds = {f.name: f.dataType for f in SCHEMAS[table]}
    absent = [c for c in STATED.get(table, ()) if c not in new_rows.columns]
    for name in ("id", *absent):
        new_rows = new_rows.withColumn(name, F.lit(None))
    order = [f"_order{i}" for i in range(len(order_by))]
    rows = new_rows.select(
        *typed_columns(new_rows, table), *[F.col(c).alias(o) for c, o in zip(order_by, order)]
    )
    for name in BLANK_AS_NULL.get(table, ()):
        rows = rows.withColumn(name, F.when(~_is_blank(name, kinds[name]), F.col(name)))
    if as_of is not None:
        for name in ("created_at", "updated_at"):
            if name in kinds:
                rows = rows.withColumn(name, F.coalesce(name, ts_lit(as_of)))
    reasons = [
        F.when(_is_blank(name, kinds[name]), F.lit(f"missing:{name}"))
        for name in FILLED.get(table, ())
    ]
    reasons.append(first_violation(table))
    for name, parent in (parents or {}).items():
        known = parent.select(F.col("id").alias(name), F.lit(True).alias(f"_known_{name}"))
        rows = rows.join(known, name, "left")
        lost = F.col(name).isNotNull() & F.col(f"_known_{name}").isNull()
        reasons.append(F.when(lost, F.lit(f"unknown:{name}")))
    checked = rows.withColumn("reject_reason", F.coalesce(*reasons))
    data = [c for c in kinds if c != "id"]
    rejected = checked.where(F.col("reject_reason").isNotNull()).select(
        *[F.col(o).alias(c) for c, o in zip(order_by, order) if c not in data],
        *data,
        "reject_reason",
    )
    fitting = checked.where(F.col("reject_reason").isNull()).select(*data, *order)
    numbered = dense_index(fitting, [F.col(o) for o in order], "_n")
    accepted = numbered.withColumn("id", F.col("_n") + F.lit(next_id(base))).select(*base.columns)
    return Inserted(base.unionByName(accepted), accepted, rejected)


def update_rows(
    base: DataFrame,
    changes: DataFrame,
    columns: Sequence[str],
    table: str | None = None,
    seq: str = "seq",
) -> Updated:
    """Replace ``columns`` of the rows named by ``id``; of several changes the last ``seq`` wins.

    A change sets every listed column, NULL included. With ``table`` given, changes that do not
    fit its declaration are rejected. Changes shrink to one per id before they are joined.
    """
    reason = first_violation(table, list(columns)) if table else F.lit(None).cast("string")
    checked = changes.withColumn("reject_reason", reason)
    rejected = checked.where(F.col("reject_reason").isNotNull())
    latest = (
        checked.where(F.col("reject_reason").isNull())
        .groupBy("id")
        .agg(F.max(F.struct(seq, *columns)).alias("_change"))
    )
    types = dict(base.dtypes)
    picked = [
        F.when(F.col("_change").isNotNull(), F.col(f"_change.{c}").cast(types[c]))
        .otherwise(F.col(c))
        .alias(c)
        if c in columns
        else F.col(c)
        for c in base.columns
    ]
    rows = base.join(latest, "id", "left").select(*picked)
    unknown = latest.select("id").join(base.select("id"), "id", "left_anti")
    return Updated(rows, unknown, rejected)


def mark_reminders_sent(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Set the reminder flag of the tasks named in ``ids``."""
    named = ids.select("id").distinct().withColumn("_named", F.lit(True))
    flag = F.when(F.col("_named"), F.lit(True)).otherwise(F.col("reminder_sent"))
    return tasks.join(named, "id", "left").withColumn("reminder_sent", flag).select(*tasks.columns)


def delete_set_null(child: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The child table once the parents named in ``ids`` are gone: their references are NULL."""
    gone = ids.select(F.col("id").alias(column)).distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return child.join(gone, column, "left").withColumn(column, kept).select(*child.columns)


def delete_rows(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows by id, with what that does to the tables referring to them.

    ``tables`` holds the table and those of its dependants that are to be kept consistent; all
    of them are returned. Dependants of deleted dependants are followed too.
    """
    found = dict(tables)
    found[table] = tables[table].join(ids.select("id"), "id", "left_anti")
    for child, column, action in REFERENCES.get(table, ()):
        if child not in found:
            continue
        if action == "set null":
            found[child] = delete_set_null(found[child], column, ids)
            continue
        gone = ids.select(F.col("id").alias(column))
        if any(grandchild in found for grandchild, _, _ in REFERENCES.get(child, ())):
            orphans = found[child].join(gone, column, "left_semi").select("id")
            found.update(delete_rows(found, child, orphans))
        else:
            found[child] = found[child].join(gone, column, "left_anti")
    return found


def replace_children(
    children: DataFrame,
    fk: str,
    parents: DataFrame,
    new_children: DataFrame,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Drop every child of the ``parents`` (one ``id`` column) and put the new ones in place.

    Where children have ids, the new ones are numbered on in ``order_by`` order.
    """
    gone = parents.select(F.col("id").alias(fk))
    kept = children.join(gone, fk, "left_anti")
    if "id" in children.columns:
        numbered = dense_index(new_children, [F.col(c) for c in order_by], "_n")
        new_children = numbered.withColumn("id", F.col("_n") + F.lit(next_id(children)))
    return kept.unionByName(new_children.select(*children.columns))
