"""Streams come to what a batch over the same rows comes to."""

import os
import shutil

import shop
from pyspark.sql import functions as F
from shop import at, frame, rows
from test_intake import feed, lines, random_sales, sale, state

from tallybook.operators.intake import order_intake
from tallybook.sources.scratch import materialize
from tallybook.streaming.daily_sales import daily_figures, daily_sales, run_daily_sales, run_daily_sales_and_late
from tallybook.streaming.files import latest, merged_upto, read_batches, read_stream, write_batch
from tallybook.streaming.order_intake import current_state, flatten, run_order_intake, sale_feed_documents
from tallybook.streaming.recipe_log import action_counts, append_actions, count_actions


def drop(df, folder, step):
    """Let the rows arrive as one file, later than all before it."""
    df.coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.startswith("part-") and os.path.getmtime(path) > 1_500_000_000 + 1000 * step:
            os.utime(path, (1_500_000_000 + step, 1_500_000_000 + step))


ACTIONS = "id bigint, recipe_id bigint, action string, created_at timestamp_ntz"


def test_recipe_log(spark, folder):
    now = at("2024-07-01")
    first = frame(spark, ACTIONS, [(1, 1, "viewed", now), (2, 1, "eaten", now), (3, 2, "printed", now)])
    second = frame(spark, ACTIONS, [(4, 1, "viewed", now), (5, None, "viewed", now), (6, 2, "prepared", now)])
    drop(first, f"{folder}/in", 1)
    arriving = read_stream(spark, f"{folder}/in", ACTIONS, files_per_batch=1)
    append_actions(arriving, f"{folder}/log", f"{folder}/c1").awaitTermination()
    count_actions(arriving, f"{folder}/counts", f"{folder}/c2").awaitTermination()
    drop(second, f"{folder}/in", 2)
    append_actions(arriving, f"{folder}/log", f"{folder}/c1").awaitTermination()
    count_actions(arriving, f"{folder}/counts", f"{folder}/c2").awaitTermination()

    log = spark.read.parquet(f"{folder}/log")
    assert sorted(r["id"] for r in log.collect()) == [1, 3, 4, 6]
    counts = latest(spark, f"{folder}/counts", ["recipe_id", "action"])
    assert sorted(rows(counts)) == sorted(rows(action_counts(first.unionByName(second))))
    assert (1, "viewed", 2) in rows(counts)


def test_recipe_queries_take_in_actions_to_refuse(spark, monkeypatch):
    """What arrives at the registered streams holds every event, unknown actions too."""
    from tallybook.plans import streams
    from tallybook.schemas import RECIPE_ACTIONS
    from tallybook.sources.bindings import Bindings

    b = Bindings(spark, "/root/testdata/sf0.001")
    feed = b.recipe_feed
    assert feed.count() == b.source("events").count() > feed.where(feed.action.isin(*RECIPE_ACTIONS)).count()
    arrived = []
    for name in ("append_actions", "count_actions"):
        own = getattr(streams, name)
        monkeypatch.setattr(streams, name, lambda df, *a, own=own: arrived.append(df) or own(df, *a))
    logged, counted = (streams.QUERIES[f"stream_recipe_{x}"](b) for x in ("log", "counts"))
    assert len(arrived) == 2 and not any("Filter" in df._jdf.queryExecution().analyzed().toString() for df in arrived)
    assert sorted(rows(logged), key=str) == sorted(rows(b.recipe_log), key=str)
    assert sorted(rows(counted)) == sorted(rows(action_counts(feed)))


SALES = "order_date timestamp_ntz, total_amount decimal(10,2)"


def sold(spark, *entries):
    return frame(spark, SALES, [(at(when), shop.Decimal(amount)) for when, amount in entries])


def test_daily_sales_drop_only_what_is_too_late(spark, folder):
    batches = [
        sold(spark, ("2024-01-01T10:00:00", "1.00"), ("2024-01-02T10:00:00", "2.00")),
        # Within a day of the newest order: still counted.
        sold(spark, ("2024-01-01T20:00:00", "4.00"), ("2024-01-05T00:00:00", "8.00")),
        # The watermark stands at 2024-01-04 now.
        sold(spark, ("2024-01-01T23:00:00", "16.00"), ("2024-01-04T12:00:00", "32.00")),
    ]
    for step, batch in enumerate(batches):
        drop(batch, f"{folder}/in", step)
        arriving = read_stream(spark, f"{folder}/in", SALES, files_per_batch=1)
        run_daily_sales(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = latest(spark, f"{folder}/out", ["day"]).select(F.col("day").cast("string"), "total", "orders")
    assert sorted(rows(found)) == [
        ("2024-01-01", shop.Decimal("5.00"), 2),
        ("2024-01-02", shop.Decimal("2.00"), 1),
        ("2024-01-04", shop.Decimal("32.00"), 1),
        ("2024-01-05", shop.Decimal("8.00"), 1),
    ]


def test_late_orders_are_counted_and_kept(spark, folder):
    batches = [
        sold(spark, ("2024-01-01T10:00:00", "1.00"), ("2024-01-02T10:00:00", "2.00"), ("2024-01-02T11:00:00", "3.00")),
        sold(spark, ("2024-01-01T20:00:00", "4.00"), ("2024-01-05T00:00:00", "8.00")),
        # The newest is 2024-01-05 now: a day is closed if it ended by 2024-01-04.
        frame(spark, SALES, [(at("2024-01-01T23:00:00"), shop.Decimal("16.00")), (at("2024-01-04T12:00:00"), shop.Decimal("32.00")),
              (at("2024-01-03T12:00:00"), shop.Decimal("64.00")), (None, shop.Decimal("128.00"))]),
        sold(spark, ("2024-01-04T01:00:00", "256.00")),
    ]
    for step, batch in enumerate(batches):
        drop(batch, f"{folder}/in", step)
    arriving = read_stream(spark, f"{folder}/in", SALES, files_per_batch=1)
    run_daily_sales_and_late(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()

    def found():
        days = daily_figures(spark, f"{folder}/out", 4).select(F.col("day").cast("string"), "total", "orders")
        late = read_batches(spark, f"{folder}/out", "late", 4)
        bounds = spark.read.parquet(f"{folder}/out/bounds").orderBy("batch").select("rows", "late", "undated")
        return sorted(rows(days)), sorted(r["total_amount"] for r in late.collect()), [tuple(r) for r in bounds.collect()]

    want = (
        [("2024-01-01", shop.Decimal("5.00"), 2), ("2024-01-02", shop.Decimal("5.00"), 2),
         ("2024-01-04", shop.Decimal("288.00"), 2), ("2024-01-05", shop.Decimal("8.00"), 1)],
        [shop.Decimal(x) for x in ("16.00", "64.00", "128.00")],
        [(3, 0, 0), (2, 0, 0), (4, 3, 1), (1, 0, 0)],
    )
    assert found() == want
    # All batches run again, as from a lost checkpoint, write the same.
    run_daily_sales_and_late(arriving, f"{folder}/out", f"{folder}/state2").awaitTermination()
    assert found() == want


def test_a_replayed_file_of_actions_changes_nothing(spark, folder):
    now, later, last = at("2024-07-01"), at("2024-07-03"), at("2024-07-20")
    files = [
        [(1, 1, "viewed", now), (2, 1, "eaten", now), (3, 2, "printed", now), (3, 2, "printed", now)],
        [(4, 1, "viewed", later), (1, 1, "viewed", now)],
        [(1, 1, "viewed", now), (2, 1, "eaten", now), (3, 2, "printed", now)],
        [(5, 1, "viewed", last), (4, 1, "viewed", later)],
    ]
    for step, entries in enumerate(files):
        drop(frame(spark, ACTIONS, entries), f"{folder}/in", step)
        # Started anew for every file: what was seen is kept between batches and runs.
        arriving = read_stream(spark, f"{folder}/in", ACTIONS, files_per_batch=1)
        append_actions(arriving, f"{folder}/log", f"{folder}/c", "30 days").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/log").collect()) == [1, 3, 4, 5]


def test_daily_sales_equal_the_batch(spark):
    found = daily_sales(shop.orders(spark)).select("day", "total", "orders")
    want = shop.orders(spark).groupBy(F.to_date("order_date").alias("day")).agg(
        F.sum("total_amount"), F.count(F.lit(1))
    )
    assert sorted(rows(found)) == sorted(rows(want))


def test_oversized_sale_documents_are_put_together(spark):
    many = lines(spark, *[(1, n, n, 1, shop.Decimal("1.00"), None) for n in range(1, 31)], (2, 1, 5, 1, None, shop.Decimal("2.00")))
    heads, flat = flatten(sale_feed_documents(feed(spark, sale(1), sale(2), sale(3)), many, part_rows=7))
    assert sorted(r["feed_id"] for r in heads.collect()) == [1, 2, 3]
    assert sorted(rows(flat), key=repr) == sorted(rows(many), key=repr)


def contents(df, *columns):
    return sorted(rows(df.select(*columns)), key=repr)


TABLES = {
    "customers": ("id", "name"),
    "products": ("id", "current_stock"),
    "orders": ("id", "order_number", "customer_id", "total_amount", "channel", "order_date"),
    "order_items": ("order_id", "product_id", "quantity", "unit_price"),
    "financial_transactions": ("id", "description", "amount", "transaction_date"),
}


def test_intake_in_batches_equals_one_batch(spark, folder):
    levels = {1: 30, 2: 20, 3: 25}
    sales, asked = random_sales(5, 45, 3)
    # Arrival in file order is what the batches have to keep.
    sales = [{**s, "arrival_seq": s["feed_id"]} for s in sales]
    sales.append(sale(46, status=None))
    base = {name: materialize(df) for name, df in state(spark, levels).items()}
    whole = order_intake(feed(spark, *sales), lines(spark, *asked), base, 2024)

    documents = sale_feed_documents(feed(spark, *sales), lines(spark, *asked))
    schema = documents.schema
    for step, low in enumerate((0, 10, 20, 28, 37)):
        high = (10, 20, 28, 37, 99)[step]
        drop(documents.where(F.col("feed_id").between(low + 1 if low else 0, high)), f"{folder}/in", step)
    arriving = read_stream(spark, f"{folder}/in", schema, files_per_batch=1)
    run_order_intake(arriving, base, f"{folder}/out", f"{folder}/state", 2024, merge_every=2).awaitTermination()

    assert len([n for n in os.listdir(f"{folder}/out/orders") if n.startswith("batch=")]) == 5
    # Merged before the third and the fifth batch: what is read is one merged folder and the rest.
    assert [merged_upto(spark, f"{folder}/out", n) for n in range(6)] == [-1, -1, 1, 1, 3, 3]
    assert len({os.path.dirname(f) for f in read_batches(spark, f"{folder}/out", "orders", 5).inputFiles()}) == 2
    after = current_state(base, f"{folder}/out", 5)
    for name, columns in TABLES.items():
        assert contents(after[name], *columns) == contents(whole.state[name], *columns), name
    rejected = spark.read.parquet(f"{folder}/out/rejected")
    assert contents(rejected, "feed_id", "reject_reason") == contents(whole.rejected, "feed_id", "reject_reason")

    # The last batch is run again, as after a crash before it was noted as done.
    shutil.copytree(f"{folder}/state", f"{folder}/crashed")
    os.remove(f"{folder}/crashed/commits/4")
    for name in os.listdir(f"{folder}/crashed/commits"):
        if name.endswith(".crc") and ".4." in name:
            os.remove(f"{folder}/crashed/commits/{name}")
    # The merge before it had failed half way.
    shutil.rmtree(f"{folder}/out/lists/until=3")
    run_order_intake(arriving, base, f"{folder}/out", f"{folder}/crashed", 2024, merge_every=2).awaitTermination()
    assert merged_upto(spark, f"{folder}/out", 5) == 3
    again = current_state(base, f"{folder}/out", 5)
    for name, columns in TABLES.items():
        assert contents(again[name], *columns) == contents(whole.state[name], *columns), name


def test_a_batch_folder_is_overwritten_not_added_to(spark, folder):
    write_batch(frame(spark, "k bigint, v bigint", [(1, 1)]), folder, 0)
    write_batch(frame(spark, "k bigint, v bigint", [(1, 2)]), folder, 0)
    write_batch(frame(spark, "k bigint, v bigint", [(1, 3), (2, 4)]), folder, 1)
    assert sorted(rows(latest(spark, folder, ["k"]))) == [(1, 3), (2, 4)]




def few_events(spark, folder, count=40):
    """Events of a month, written in many files."""
    kinds = ("view", "purchase", "click", "error")
    events = [(k, at(f"2024-01-{1 + k % 30:02d}"), k % 3, kinds[k % 4], 1.0, None) for k in range(count)]
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    frame(spark, columns, events).repartition(8).write.parquet(f"{folder}/events.parquet")


def test_a_log_of_many_files_is_counted_in_few_batches(spark, folder, monkeypatch):
    from tallybook.plans import streams
    from tallybook.sources.bindings import Bindings

    few_events(spark, folder)
    monkeypatch.setattr(streams, "scratch_path", lambda spark, label: f"{folder}/{label}")
    b = Bindings(spark, folder)
    counts = streams.QUERIES["stream_recipe_counts_replayed"](b)
    assert sorted(rows(counts)) == sorted(rows(action_counts(b.recipe_feed)))
    written = len(spark.read.parquet(f"{folder}/recipe-counts/log").inputFiles())
    batches = [x for x in os.listdir(f"{folder}/recipe-counts/out") if x.startswith("batch=")]
    assert written > 2 * streams.COUNT_BATCHES >= 2 * len(batches) > 2


def test_a_step_arrives_in_many_files_and_one_batch(spark, folder):
    from tallybook.plans.streams import _arrive
    from tallybook.streaming.files import write_updates

    few_events(spark, folder)
    events = spark.read.parquet(f"{folder}/events.parquet").repartition(8)
    steps = [F.col("event_id") % 2 == 0, F.col("event_id") < 0, F.col("event_id") % 2 == 1]
    _arrive(events, folder, steps, lambda df: write_updates(df.select("event_id"), f"{folder}/out", f"{folder}/state"))
    found = spark.read.parquet(f"{folder}/out")
    assert sorted(rows(found.groupBy("batch").count())) == [(0, 20), (2, 20)]
    assert len(spark.read.parquet(f"{folder}/feed").inputFiles()) > 3
