import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from fareline import session
from fareline.operators import filters, listings, seats
from fareline.plans import catalog
from fareline.sources.derived import DerivedTables
from fareline.sources.schemas import TABLES
from fareline.sources.tables import Tables, load_tables, open_tables, save_tables, write_table, write_tables
from tests.tiny import DAY, dicts, small_world


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    t = small_world(
        spark,
        bookings=[
            {"booking_id": i, "journey_date": DAY + dt.timedelta(days=i % 3), "status": "confirmed"}
            for i in range(30)
        ],
    )
    folder = str(tmp_path_factory.mktemp("store") / "tables")
    write_tables(t, folder)
    return t, folder


def test_tables_come_back_as_written(spark, stored):
    t, folder = stored
    again = load_tables(spark, folder)
    for name, schema in TABLES.items():
        got, want = getattr(again, name), getattr(t, name)
        assert got.schema == schema
        assert sorted(map(str, dicts(got))) == sorted(map(str, dicts(want)))


def test_journey_date_prunes_partitions_and_filters_reach_the_scan(spark, stored):
    b = load_tables(spark, stored[1]).bookings
    one = filters.filter_bookings(b, "confirmed", DAY).select("booking_id")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(journey_date" in plan
    assert "IsNotNull(status)" in plan
    assert "ReadSchema: struct<booking_id:bigint,status:string>" in plan
    assert len(one.collect()) == 10


def test_a_snapshot_is_never_overwritten(spark, stored):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_table(stored[0].buses, f"{stored[1]}/buses")


@pytest.fixture
def no_broadcast(spark):
    keys = [
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
    ]
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_payment_fan_out_shuffles_the_bookings_once(spark, stored, no_broadcast):
    t = load_tables(spark, stored[1])
    assert "ReusedExchange [booking_id" in final_plan(listings.booking_list(t, ordered=False))


def test_bucketed_tables_join_without_a_shuffle(spark, stored, no_broadcast, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    save_tables(stored[0], "bucketed", buckets=4)
    t = open_tables(spark, "bucketed")
    for name, schema in TABLES.items():
        got, want = getattr(t, name), getattr(stored[0], name)
        assert got.schema == schema
        assert sorted(map(str, dicts(got))) == sorted(map(str, dicts(want)))
    paid = listings.with_payments(t.bookings, t.payments.select("booking_id", "payment_method"))
    assert "Exchange" not in final_plan(paid)
    first = t.bookings.join(listings.first_payment(t.payments), "booking_id", "left")
    assert "Exchange" not in final_plan(first)
    held = seats.live_holds(t)
    assert "Exchange" not in final_plan(held)


def test_totals_see_every_column(spark, stored):
    t = stored[0]
    whole = {r["table_name"]: r["row_sum"] for r in dicts(catalog.snapshot_totals(t))}
    for name, schema in TABLES.items():
        for field in schema.fields:
            if getattr(t, name).isEmpty():
                continue
            garbled = getattr(t, name).withColumn(
                field.name, F.when(F.col(field.name).isNull(), F.lit("1").try_cast(field.dataType))
            )
            other = Tables(**{**t.__dict__, name: garbled})
            assert {r["table_name"]: r["row_sum"] for r in dicts(catalog.snapshot_totals(other))}[name] != whole[name], field


def test_bucketed_tables_have_a_file_per_bucket(spark, stored, tmp_path):
    spark.sql(f"CREATE DATABASE few_files LOCATION '{tmp_path}/db'")
    save_tables(stored[0], "few_files", buckets=3)
    for name in ("bookings", "booking_seat", "payments"):
        files = [f for _, _, names in os.walk(f"{tmp_path}/db/{name}") for f in names if f.endswith(".parquet")]
        assert len(files) <= 3


def test_work_folders_are_fresh_and_checkpoints_enabled(spark):
    assert session.work_folder(spark, "x") != session.work_folder(spark, "x")
    session.enable_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()


CLEAN_SESSION = """
import os
from pyspark.sql import SparkSession
from fareline import session
from fareline.plans.catalog import queries

spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{shared}").getOrCreate()
)
for name in ("w11_admit_users", "st2_payment_totals"):
    queries()[name](spark, "/root/testdata/sf0.001").count()
files = lambda: [f for _, _, names in os.walk("{shared}") for f in names]
assert files()
session.finish(spark)
assert not files(), files()
"""


def test_nothing_is_left_after_the_end(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = CLEAN_SESSION.format(shared=tmp_path / "shared")
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


OTHER_SESSION = """
from pyspark.sql import SparkSession
from fareline import session

spark = (
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "{shared}").getOrCreate()
)
assert session.work_folder(spark, "x").startswith("{shared}/x-"), session.work_folder(spark, "x")
assert "{shared}" in spark.range(3).checkpoint().sparkSession.sparkContext.getCheckpointDir()
"""


def test_work_folder_follows_the_cluster_setting(tmp_path):
    """The setting is fixed when a session starts, so this takes a session of its own."""
    code = OTHER_SESSION.format(shared=tmp_path / "shared")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_few_partition_values_are_written_without_a_shuffle(spark, tmp_path):
    rows = spark.range(0, 100, 1, 4).select("id", (F.col("id") % 2).alias("day"))
    for values, files in ((2, 8), (100, 2), (None, 2)):
        path = str(tmp_path / f"v{values}")
        write_table(rows, path, ["day"], ["id"], values)
        assert len([f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]) == files
        assert sorted(map(tuple, spark.read.parquet(path).select("id", "day").collect())) == [(i, i % 2) for i in range(100)]


MIN_SIZE = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


@pytest.fixture
def own_shuffles(spark):
    session._FITTED.clear()
    yield
    session._FITTED.clear()
    for key in (session._START, session._TARGET, MIN_SIZE):
        spark.conf.unset(key)


def test_shuffles_grow_in_number_with_the_input(spark, own_shuffles, monkeypatch):
    folder = "/root/testdata/sf0.001"
    DerivedTables(spark, folder)
    assert spark.conf.get(session._START, None) is None  # small: as the session has it
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 4096)
    t = DerivedTables(spark, folder)
    n = int(spark.conf.get(session._START))
    assert n > 8
    spark.conf.set(MIN_SIZE, "1b")  # the rows are too few to stay apart otherwise
    assert seats.live_holds(t).groupBy("seat_id").count().rdd.getNumPartitions() > 8
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 2048)
    DerivedTables(spark, folder)
    assert int(spark.conf.get(session._START)) > n
    spark.conf.set(session._START, "9")  # the session's own
    DerivedTables(spark, folder)
    assert spark.conf.get(session._START) == "9"
