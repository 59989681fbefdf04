"""Reading with a declared schema, violations, appends, snapshots and documents."""

import json

import pytest
import shop
from shop import frame, rows

from tallybook.schemas import SCHEMAS
from tallybook.sources import tables
from tallybook.sources.scratch import materialize, scratch_root


def test_conform_casts_fills_and_reports(spark):
    loose = frame(
        spark,
        "id string, name string, category string, minimum_stock string, unit string, extra int",
        [("1", "a", "x", "7", "un", 1), ("2", None, "x", "many", "un", 1)],
    )
    got = tables.conform(loose, "products")
    assert got.columns == SCHEMAS["products"].names
    first, second = got.orderBy("id").collect()
    assert (first["id"], first["current_stock"], first["minimum_stock"]) == (1, 0, 7)
    assert second["minimum_stock"] is None
    assert [(r["id"], r["reason"]) for r in tables.violations(got, "products").collect()] == [(2, "missing:name")]


def test_conform_needs_required_columns(spark):
    with pytest.raises(ValueError, match="category"):
        tables.conform(frame(spark, "id bigint, name string", []), "products")


def test_enum_violations(spark):
    t = shop.tasks(spark)
    assert [(r["id"], r["reason"]) for r in tables.violations(t, "tasks").collect()] == [(4, "invalid:priority")]
    assert tables.violations(shop.orders(spark), "orders").count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_load_tables(spark, folder, fmt):
    shop.orders(spark).write.format(fmt).save(f"{folder}/orders")
    shop.oil_disposals(spark).write.format(fmt).save(f"{folder}/oil")
    got = tables.load_tables(spark, {"orders": f"{folder}/orders", "oil_disposals": f"{folder}/oil"}, fmt)
    assert sorted(rows(got["orders"])) == sorted(rows(shop.orders(spark)))
    assert sorted(rows(got["oil_disposals"])) == sorted(rows(shop.oil_disposals(spark)))


def test_append_rows(spark, folder):
    tables.append_rows(shop.task_categories(spark), f"{folder}/t")
    tables.append_rows(shop.task_categories(spark), f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").count() == 4


def test_snapshots_leave_older_versions_alone(spark, folder):
    tables.write_snapshot({"products": shop.products(spark)}, folder, "1")
    old = tables.read_snapshot(spark, folder, "1", ["products"])["products"]
    tables.write_snapshot({"products": old.where("id > 3")}, folder, "2")
    assert old.count() == 8
    assert tables.read_snapshot(spark, folder, "2", ["products"])["products"].count() == 5


def test_documents_keep_nulls_and_nesting(spark, folder):
    from tallybook.operators.sales import sales_documents

    found = sales_documents(
        shop.orders(spark), shop.customers(spark), shop.order_items(spark), shop.products(spark)
    )
    documents = {d["id"]: d for d in (json.loads(r[0]) for r in tables.to_json_documents(found).collect())}
    assert documents[11]["items"] == [] and documents[11]["ifood_order"] is None
    assert documents[2]["items"] == [{"product": "COXINHA", "quantity": 50, "valor": 1.0}]
    tables.write_json_documents(found, f"{folder}/json")
    assert spark.read.text(f"{folder}/json").count() == 12


def test_scratch_tables_live_in_the_named_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = materialize(frame(spark, "a int", [(1,)]))
    assert rows(kept) == [(1,)]
    assert all(f.startswith(f"file://{scratch_root(spark)}/") for f in kept.inputFiles())


def test_load_tables_query_reads_files(spark, monkeypatch):
    from tallybook.plans import writes
    from tallybook.sources.bindings import Bindings

    read = []
    own = tables.load_tables
    monkeypatch.setattr(tables, "load_tables", lambda s, paths, *a: read.append(paths) or own(s, paths, *a))
    found = writes._load_tables(Bindings(spark, "/root/testdata/sf0.001")).collect()
    assert len(read) == 1 and set(read[0]) == {r.table_name for r in found} and len(found) == 11
