import datetime as dt
import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fareline.operators import changes
from fareline.sources.schemas import RAW
from fareline.streaming import live
from tests.test_changes import LOG
from tests.tiny import dicts, small_world

START = dt.datetime(2024, 1, 1)
ARROW = pa.schema(
    [
        ("change_id", pa.int64()),
        ("ts", pa.timestamp("us")),
        ("booking_id", pa.int64()),
        ("kind", pa.string()),
        ("new_status", pa.string()),
        ("payment_method", pa.string()),
        ("user_id", pa.int64()),
    ]
)


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    """Six files of changes whose times are shuffled across files; one booking takes a third of them."""
    rnd = random.Random(3)
    folder = tmp_path_factory.mktemp("changes")
    minutes = rnd.sample(range(10_000), 300)
    rows = []
    for i in range(300):
        booking = 7 if i % 3 == 0 else rnd.randrange(1, 25)
        pay = rnd.random() < 0.4
        rows.append(
            {
                "change_id": i,
                "ts": START + dt.timedelta(minutes=minutes[i]),
                "booking_id": booking,
                "kind": "pay" if pay else "set_status",
                "new_status": None if pay else rnd.choice(["pending", "confirmed", "cancelled"]),
                "payment_method": rnd.choice(["Cash", "bKash"]) if pay else None,
                "user_id": booking % 3 if rnd.random() < 0.8 else 99,
            }
        )
    for n in range(6):
        part = pa.Table.from_pylist(rows[n * 50 : (n + 1) * 50], schema=ARROW)
        pq.write_table(part, os.path.join(folder, f"part-{n}.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def world(spark):
    return small_world(
        spark, bookings=[{"booking_id": b, "user_id": b % 3} for b in range(1, 21)]
    )


def both(spark, arrived):
    schema = spark.createDataFrame([], LOG).schema
    return (
        live.file_stream(spark, arrived, schema, files_per_batch=1),
        spark.read.schema(schema).parquet(arrived),
    )


def test_status_stream_equals_batch(spark, arrived, world):
    stream, batch = both(spark, arrived)
    claims = live.run_available(stream, live.STATUS_VIEW, "status")
    got = live.settled_status(claims, world.bookings)
    want = live.settled_status(live.status_claims(batch), world.bookings)
    key = lambda r: r["booking_id"]
    assert sorted(dicts(got), key=key) == sorted(dicts(want), key=key)
    assert len(dicts(got)) == 20
    table = {r["booking_id"]: r["status"] for r in changes.apply_changes(world, batch).bookings.collect()}
    for row in dicts(got):
        assert table[row["booking_id"]] == row["status"]


def test_payment_stream_equals_batch(spark, arrived, world):
    stream, batch = both(spark, arrived)
    claims = live.run_available(stream.filter("kind = 'pay'"), live.PAYMENT_VIEW, "totals")
    got = live.settled_totals(claims, world.bookings)
    want = live.settled_totals(live.payment_claims(batch.filter("kind = 'pay'")), world.bookings)
    key = lambda r: r["payment_method"]
    assert sorted(dicts(got), key=key) == sorted(dicts(want), key=key)
    posted = changes.post_payments(world, batch.filter("kind = 'pay'")).payments.count()
    assert sum(r["n_payments"] for r in dicts(got)) == posted > 0
    owners = {b: b % 3 for b in range(1, 21)}
    paid = [r for r in dicts(batch) if r["kind"] == "pay" and owners.get(r["booking_id"]) == r["user_id"]]
    for row in dicts(got):
        n = sum(r["payment_method"] == row["payment_method"] for r in paid)
        assert (row["n_payments"], row["revenue"]) == (n, 10 * n)


def test_a_stream_without_data_gives_no_rows(spark, tmp_path, world):
    stream = live.file_stream(spark, str(tmp_path), spark.createDataFrame([], LOG).schema)
    claims = live.run_available(stream, live.STATUS_VIEW, "nothing")
    assert dicts(live.settled_status(claims, world.bookings)) == []


def test_a_view_goes_on_where_it_stopped(spark, arrived, world, tmp_path):
    stream, batch = both(spark, arrived)
    source = tmp_path / "in"
    source.mkdir()
    folder = str(tmp_path / "view")
    schema = stream.schema
    for n in range(6):
        shutil.copy(os.path.join(arrived, f"part-{n}.parquet"), source)
        if n in (1, 5):
            again = live.file_stream(spark, str(source), schema)
            live.start_view(again, live.STATUS_VIEW, folder, availableNow=True).awaitTermination()
    claims = live.read_view(spark, live.STATUS_VIEW, folder, live.status_claims(batch).schema)
    want = live.settled_status(live.status_claims(batch), world.bookings)
    key = lambda r: r["booking_id"]
    got = live.settled_status(claims, world.bookings)
    assert sorted(dicts(got), key=key) == sorted(dicts(want), key=key)


def test_streams_read_a_declared_schema(spark):
    view = live.file_stream(spark, "/root/testdata/sf0.001", RAW["events"], "events.parquet")
    assert view.isStreaming and view.schema == RAW["events"]


@pytest.fixture
def payment_view(spark, arrived, tmp_path):
    """A view that six micro-batches went into, its parts as a frame, and what it should hold."""
    schema = spark.createDataFrame([], LOG).schema
    folder = str(tmp_path / "view")
    batch = spark.read.schema(schema).parquet(arrived).filter("kind = 'pay'")
    stream = live.file_stream(spark, arrived, schema, files_per_batch=1).filter("kind = 'pay'")
    live.start_view(stream, live.PAYMENT_VIEW, folder, merge_every=4, kept_versions=2, availableNow=True).awaitTermination()
    claims = live.payment_claims(batch)
    return folder, live.view_tables(spark, folder, claims.schema), sorted(dicts(claims), key=str)


def rows_of(df):
    return sorted(dicts(df), key=str)


def commits(tables):
    return sorted(n for n in os.listdir(f"{tables.folder}/parts"))


def test_parts_and_folders_stay_bounded(spark, payment_view):
    folder, tables, want = payment_view
    version = tables.open()
    # Four batches, their merged part, two more batches; versions before the merge are gone.
    assert (version.number, version.notes["batch"], tables.parts_of(version, "parts")) == (6, 5, 3)
    assert tables.numbers() == [3, 4, 5, 6]
    assert rows_of(live.read_view(spark, live.PAYMENT_VIEW, folder, tables.schemas["parts"])) == want
    live.merge_parts(tables, live.PAYMENT_VIEW, kept_versions=1)
    assert tables.numbers() == [7] and len(commits(tables)) == 1
    assert rows_of(live.read_view(spark, live.PAYMENT_VIEW, folder, tables.schemas["parts"])) == want


def test_a_reader_goes_on_beside_a_merge(spark, payment_view):
    folder, tables, want = payment_view
    reader = live.read_view(spark, live.PAYMENT_VIEW, folder, tables.schemas["parts"])
    version = live.merge_parts(tables, live.PAYMENT_VIEW, kept_versions=2)
    assert tables.parts_of(version, "parts") == 1
    assert rows_of(reader) == want


def test_a_crash_between_write_and_swap(spark, payment_view, monkeypatch):
    folder, tables, want = payment_view

    def dies(*args, **notes):
        raise RuntimeError("lost")

    before = commits(tables)
    monkeypatch.setattr(live.VersionedTables, "publish", dies)
    with pytest.raises(RuntimeError, match="lost"):
        live.merge_parts(tables, live.PAYMENT_VIEW)
    monkeypatch.undo()
    assert len(commits(tables)) == len(before) + 1
    assert rows_of(live.read_view(spark, live.PAYMENT_VIEW, folder, tables.schemas["parts"])) == want
    tables.sweep()
    assert commits(tables) == before


def test_a_repeated_batch_is_passed_over(spark, arrived, payment_view):
    """The stream lost its own notes after the swap: all six files come again as the same batches."""
    folder, tables, want = payment_view
    shutil.rmtree(f"{folder}/checkpoint")
    schema = spark.createDataFrame([], LOG).schema
    stream = live.file_stream(spark, arrived, schema, files_per_batch=1).filter("kind = 'pay'")
    live.start_view(stream, live.PAYMENT_VIEW, folder, availableNow=True).awaitTermination()
    assert rows_of(live.read_view(spark, live.PAYMENT_VIEW, folder, tables.schemas["parts"])) == want


def test_owner_is_settled_when_the_view_is_read(spark, world):
    log = spark.createDataFrame(
        [
            (1, START, 7, "pay", None, "Cash", None),
            (2, START, 7, "pay", None, "Cash", 1),
            (3, START, 7, "pay", None, "Cash", 2),
            (4, START, 999, "pay", None, "Cash", None),
        ],
        LOG,
    )
    totals = dicts(live.settled_totals(live.payment_claims(log), world.bookings))
    assert [(r["payment_method"], r["n_payments"]) for r in totals] == [("Cash", 2)]
    status = dicts(live.settled_status(live.status_claims(log), world.bookings))
    assert [(r["booking_id"], r["status"]) for r in status] == [(7, "confirmed")]
