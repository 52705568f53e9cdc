"""A booking store against the same requests over whole tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fareline.functions import fixed_values as V
from fareline.operators import booking_store, changes, counters, listings, seats
from fareline.operators.booking_store import BookingStore
from fareline.session import work_folder
from fareline.sources.schemas import TABLES
from fareline.sources.tables import Tables
from fareline.sources.versions import VersionedTables
from tests.test_admission import REQUESTS
from tests.test_changes import LOG, at
from tests.tiny import DAY, dicts, tables

DAYS = [DAY + dt.timedelta(days=i) for i in range(5)]
STATUSES = ["pending", "CONFIRMED", "cancelled", None, "lost"]


def world(spark, seed=0, n=60):
    rng = random.Random(seed)
    bookings = [
        {
            "booking_id": (i % 3 << booking_store.BLOCK_BITS) + i,
            "user_id": rng.randrange(4),
            "route_id": rng.randrange(3),
            "bus_id": rng.randrange(2),
            "journey_date": DAYS[i % 5],
            "status": rng.choice(STATUSES),
        }
        for i in range(n)
    ]
    ids = [b["booking_id"] for b in bookings]
    return tables(
        spark,
        users=[{"user_id": i, "username": f"u{i}"} for i in range(5)],
        buses=[{"bus_id": i} for i in range(2)],
        routes=[{"route_id": i} for i in range(2)],  # bookings of a third one are not listed
        seats=[{"seat_id": b * 100 + s, "bus_id": b, "seat_number": f"A{s}"} for b in range(2) for s in range(6)],
        bookings=bookings,
        booking_seat=[{"booking_id": b["booking_id"], "seat_id": b["bus_id"] * 100 + rng.randrange(6)} for b in bookings],
        payments=[
            {"payment_id": i, "booking_id": rng.choice(ids), "transaction_id": str(i), "payment_method": "Cash"} for i in range(20)
        ],
    ), ids


def log_rows(ids, seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        pay = rng.random() < 0.5
        status = None if pay else rng.choice(["pending", "confirmed", "Cancelled", " <b>lost</b>"])
        out.append((i, at(rng.randrange(50)), rng.choice([*ids, 999]), "pay" if pay else "set_status", status, "Nagad", rng.randrange(4)))
    return out


def store_of(spark, t):
    return BookingStore.create(spark, work_folder(spark, "store"), t)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, dicts(got.select(*order)))) == sorted(map(str, dicts(want.select(*order))))


def check_reports(store, t, bookings, booking_seat, payments, some=False):
    """Every report of the store, or some, against the full count over the changed tables."""
    after = Tables(**{**t.__dict__, "bookings": bookings, "booking_seat": booking_seat, "payments": payments})
    same(store.bookings(), bookings)
    if some:
        same(counters.user_booking_stats(t, kept=store), counters.user_booking_stats(after))
        return
    same(store.payments().drop("payment_id", "transaction_id"), payments.drop("payment_id", "transaction_id"))
    same(counters.dashboard_kpis(t, kept=store), counters.dashboard_kpis(after))
    same(counters.user_stats(t, kept=store), counters.user_stats(after))
    same(counters.user_booking_stats(t, kept=store), counters.user_booking_stats(after))
    same(counters.route_list(t, kept=store), counters.route_list(after))
    trips = seats.booked_trips(bookings)
    same(seats.trip_occupancy(t, trips, held=store.held_seats()), seats.trip_occupancy(after, trips))
    same(seats.seat_map(t, trips, held=store.held_seats()), seats.seat_map(after, trips))


@pytest.mark.parametrize("seed, cuts", [(1, [0, 40]), (2, [0, 3, 25, 40])])
def test_batches_in_any_split_equal_one_log_over_the_tables(spark, seed, cuts):
    t, ids = world(spark, seed)
    rows = log_rows(ids, seed)
    whole = changes.apply_changes(t, spark.createDataFrame(rows, LOG))
    store = store_of(spark, t)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        store.apply_log(spark.createDataFrame(rows[low:high], LOG), batch=k)
    # A batch that comes again is passed over.
    again = store.apply_log(spark.createDataFrame(rows, LOG), batch=len(cuts) - 2)
    assert again.rejects is None and again.version.number == store.tables.open().number
    check_reports(store, t, whole.bookings, t.booking_seat, whole.payments, some=len(cuts) == 2)


def test_one_batch_gives_the_ids_and_rejects_of_the_whole_table_job(spark):
    t, ids = world(spark, 3)
    log = spark.createDataFrame(log_rows(ids, 3), LOG)
    store = store_of(spark, t)
    done, whole = store.apply_log(log), changes.apply_changes(t, log)
    same(store.payments(), whole.payments)
    same(done.rejects, whole.rejects)


def files(store, table):
    top = f"{store.tables.folder}/{table}"
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def inputs(df):
    return {f.removeprefix("file://") for f in df.inputFiles()}


def test_only_touched_days_are_read_and_written(spark, monkeypatch):
    t, ids = world(spark, 4)
    store = store_of(spark, t)
    before = {table: files(store, table) for table in booking_store.SCHEMAS}
    opened = []
    read = type(store.tables).read

    def reading(self, version, table, partitions=None):
        df = read(self, version, table, partitions)
        opened.append((table, inputs(df)))
        return df

    monkeypatch.setattr(type(store.tables), "read", reading)
    target = ids[7]  # on day 7 % 5
    store.apply_status(spark.createDataFrame([(1, at(1), target, "set_status", "confirmed!", None, 1)], LOG))
    day = f"journey_date={DAYS[2]}"
    read_days = {os.path.basename(os.path.dirname(f)) for table, found in opened if table == "bookings" for f in found}
    assert read_days == {day}
    assert {f for table, found in opened if table == "days" for f in found} == {
        f for f in before["days"] if f"/block={target >> booking_store.BLOCK_BITS}/" in f
    }
    new = {table: files(store, table) - before[table] for table in booking_store.SCHEMAS}
    assert {os.path.basename(os.path.dirname(f)) for f in new["bookings"]} == {day}
    assert not new["days"] and not new["booking_seat"] and not new["payments"] and not new["route_totals"]
    assert files(store, "bookings") >= before["bookings"]  # an older version still has its files
    monkeypatch.undo()
    version = store.tables.open()
    kept = inputs(store.tables.read(version, "bookings"))
    assert {f for f in kept if day not in f} == {f for f in before["bookings"] if day not in f}
    plan = store.tables.read(version, "bookings", [day])._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan
    changed = {r["booking_id"]: r["status"] for r in dicts(store.bookings())}
    assert changed[target] == "confirmed!" and len(changed) == len(ids)


def test_changes_of_nothing_write_nothing(spark):
    t, ids = world(spark, 5)
    store = store_of(spark, t)
    before = {table: files(store, table) for table in booking_store.SCHEMAS}
    done = store.apply_log(spark.createDataFrame([(1, at(1), 999, "pay", None, "Cash", 1)], LOG), batch=0)
    assert [r["reason"] for r in dicts(done.rejects)] == [V.REASON_BOOKING]
    assert {table: files(store, table) for table in booking_store.SCHEMAS} == before
    assert store.tables.open().notes["batch"] == 0


def test_new_bookings_and_clashes(spark):
    t, ids = world(spark, 6)
    asked = [(i, at(i % 7), i % 4, i % 4, 1, DAYS[i % 2], [100 + i % 6, 100 + (i * 5) % 6][: i % 3], "x", "y") for i in range(30)]
    requests = spark.createDataFrame(asked, REQUESTS)
    for refuse in (False, True):
        store = store_of(spark, t)
        done = store.add_bookings(t, requests, DAY, refuse_clashes=refuse)
        whole = changes.create_bookings(t, requests, DAY, refuse_clashes=refuse)
        same(done.rejects, whole.rejects)
        same(store.booking_seat(), whole.booking_seat)
        check_reports(store, t, whole.bookings, whole.booking_seat, t.payments, some=not refuse)
        # Their days got files beside those they have.
        assert max(len(c) for c in store.tables.open().parts["bookings"].values()) == 2


def test_an_older_change_that_comes_late_does_nothing(spark):
    t, ids = world(spark, 7)
    store = store_of(spark, t)
    for k, (minute, status) in enumerate([(30, "confirmed"), (10, "cancelled"), (30, "pending")]):
        store.apply_status(spark.createDataFrame([(5 - k, at(minute), ids[0], "set_status", status, None, 1)], LOG))
    assert {r["booking_id"]: r["status"] for r in dicts(store.bookings())}[ids[0]] == "confirmed"


def test_totals_are_folded_and_old_versions_forgotten(spark):
    t, ids = world(spark, 8)
    rows = log_rows(ids, 8, 12)
    whole = changes.apply_changes(t, spark.createDataFrame(rows, LOG))
    store = store_of(spark, t)
    for low in range(0, 12, 4):
        store.apply_log(spark.createDataFrame(rows[low : low + 4], LOG))
    reader = store.bookings()  # opened before
    newest = store.fold(store.tables.open(), parts=1)
    assert all(store.tables.parts_of(newest, table) == 1 for table in ("user_totals", "holds", "payments"))
    same(reader, whole.bookings)
    store.tables.forget(keep=1)
    assert store.tables.numbers() == [newest.number]
    check_reports(store, t, whole.bookings, t.booking_seat, whole.payments)
    assert files(store, "bookings") == inputs(store.tables.read(newest, "bookings"))


def test_a_writer_that_dies_before_the_rename_changes_nothing(spark, monkeypatch):
    t, ids = world(spark, 9)
    store = store_of(spark, t)
    log = spark.createDataFrame(log_rows(ids, 9), LOG)
    before = files(store, "bookings")

    def dies(*args, **notes):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(store.tables), "publish", dies)
    with pytest.raises(RuntimeError, match="lost"):
        store.apply_log(log, batch=0)
    monkeypatch.undo()
    same(store.bookings(), t.bookings)
    assert files(store, "bookings") > before
    store.tables.sweep()
    assert files(store, "bookings") == before
    store.apply_log(log, batch=0)
    same(store.bookings(), changes.apply_changes(t, log).bookings)


def test_two_writers(spark):
    t, ids = world(spark, 10, 5)
    store = store_of(spark, t)
    base = store.tables.open()
    store.tables.publish(base, [], batch=1)
    with pytest.raises(RuntimeError, match="another writer"):
        store.tables.publish(base, [], batch=2)
    assert store.tables.open().notes["batch"] == 1


def test_empty_tables_and_null_days(spark):
    t = tables(spark, users=[{"user_id": 1}], buses=[{"bus_id": 1}], routes=[{"route_id": 1}])
    store = store_of(spark, t)
    log = spark.createDataFrame([(1, at(1), 5, "set_status", "cancelled", None, 1)], LOG)
    store.apply_log(log)
    check_reports(store, t, t.bookings, t.booking_seat, t.payments)
    asked = spark.createDataFrame([(5, at(1), 1, 1, 1, None, [1], "x", "y"), (6, at(1), 1, 1, 1, DAY, [1], "x", "y")], REQUESTS)
    store.add_bookings(t, asked, DAY)
    assert {(r["booking_id"], r["journey_date"]) for r in dicts(store.bookings())} == {(5, None), (6, DAY)}
    store.apply_log(log)
    assert {r["booking_id"]: r["status"] for r in dicts(store.bookings())} == {5: "cancelled", 6: "pending"}
    assert store.bookings().schema.names == TABLES["bookings"].names
    assert [r["n"] for r in dicts(store.held_seats())] == [1]


def test_a_stream_of_changes_in_files(spark, tmp_path):
    from fareline.streaming import live

    t, ids = world(spark, 11)
    rows = log_rows(ids, 11)
    store = store_of(spark, t)
    arriving, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    schema = spark.createDataFrame([], LOG).schema
    for low, high in ((0, 5), (5, 30), (30, 40)):
        spark.createDataFrame(rows[low:high], LOG).coalesce(1).write.mode("append").parquet(arriving)
    stream = live.file_stream(spark, arriving, schema, files_per_batch=1)
    store.follow(stream, checkpoint, availableNow=True).awaitTermination()
    assert store.tables.open().notes["batch"] == 2
    whole = changes.apply_changes(t, spark.createDataFrame(rows, LOG))
    check_reports(store, t, whole.bookings, t.booking_seat, whole.payments, some=True)


def test_a_hot_user_and_day(spark):
    t, ids = world(spark, 12, 30)
    hot = t.bookings.withColumn("user_id", F.lit(1).cast("long")).withColumn("journey_date", F.lit(DAY))
    t = Tables(**{**t.__dict__, "bookings": hot.select(*t.bookings.columns)})
    log = spark.createDataFrame([(*r[:6], 1) for r in log_rows(ids, 12, 60)], LOG)
    store = store_of(spark, t)
    store.apply_log(log)
    whole = changes.apply_changes(t, log)
    check_reports(store, t, whole.bookings, t.booking_seat, whole.payments, some=True)


def test_newest_bookings_come_from_few_days(spark):
    t, ids = world(spark, 13)
    created = F.date_add(F.lit(DAY), (F.col("booking_id") % 7).cast("int"))
    late = F.when(F.col("journey_date") == F.lit(DAYS[3]), F.date_add(F.lit(DAY), 100)).otherwise(created)
    late = F.when(F.col("journey_date") == F.lit(DAYS[1]), F.lit(None).cast("date")).otherwise(late)
    t = Tables(**{**t.__dict__, "bookings": t.bookings.withColumn("created_at", late).select(*t.bookings.columns)})
    store = store_of(spark, t)
    for n in (1, 5, 12, 200):
        for kept in (None, store):
            got = listings.recent_bookings(t, n, kept=kept).collect()
            want = want if kept else got
            assert [r.asDict() for r in got] == [r.asDict() for r in want]
    read = store.newest_bookings(5)
    assert {os.path.basename(os.path.dirname(f)) for f in inputs(read)} == {f"journey_date={DAYS[3]}"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "InMemoryFileIndex(1 paths)" in plan
    asked = spark.createDataFrame([(1, at(1), 1, 1, 1, DAYS[0], [1], "x", "y")], REQUESTS)
    store.add_bookings(t, asked, DAY + dt.timedelta(days=500))
    assert [r["journey_date"] for r in store.newest_bookings(1).collect()] == [DAYS[0]]
    assert store_of(spark, tables(spark)).newest_bookings(5).count() == 0


def test_a_batch_reads_the_bookings_of_its_days_once_and_once_to_write_them(spark, monkeypatch):
    t, ids = world(spark, 5)
    store = BookingStore.create(spark, work_folder(spark, "store"), t)
    reads, read = [], store.tables.read
    monkeypatch.setattr(store.tables, "read", lambda version, table, *rest: reads.append(table) or read(version, table, *rest))
    store.apply_log(spark.createDataFrame(log_rows(ids, 5), LOG))
    assert reads.count("bookings") == 2


def test_a_new_store_joins_buses_and_routes_only_for_its_bookings(spark, monkeypatch):
    t, _ = world(spark, 6)
    plans, write = {}, VersionedTables.write

    def noted(self, table, rows, *rest):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        return write(self, table, rows, *rest)

    monkeypatch.setattr(VersionedTables, "write", noted)
    store = store_of(spark, t)
    assert "Join" in plans["bookings"]
    assert not [table for table in ("days", "route_totals", "payment_totals") if "Join" in plans[table]]
    check_reports(store, t, t.bookings, t.booking_seat, t.payments)


def test_only_days_of_several_commits_have_their_holds_added_up(spark):
    t, ids = world(spark, 7)
    store = store_of(spark, t)

    def check(bookings):
        after = Tables(**{**t.__dict__, "bookings": bookings})
        held = seats.live_holds(after).groupBy("journey_date", "route_id", "seat_id").agg(F.count(F.lit(1)).alias("n"))
        same(store.held_seats(), held)

    def is_added():
        return "Aggregate" in store.held_seats()._jdf.queryExecution().executedPlan().toString()

    check(t.bookings)
    assert not is_added()
    changed = t.bookings.filter(F.col("journey_date") == DAYS[0]).select(
        F.lit(at(1)).alias("ts"), F.col("booking_id").alias("change_id"), "booking_id", F.lit("cancelled").alias("new_status")
    )
    store.apply_status(changed)
    check(changes.apply_status(t.bookings, changed))
    assert is_added()
