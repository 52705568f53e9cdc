"""Plan shapes and skewed data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fareline.operators import changes, counters, filters, listings, seats, signups
from fareline.plans import catalog
from fareline.session import stored
from fareline.sources.tables import Tables
from tests.test_changes import LOG, at
from tests.test_seats import random_world
from tests.tiny import DAY, dicts, tables

SF_DIR = "/root/testdata/sf0.001"
# These run jobs while they are built; their plans only read the outcome.
EAGER = {
    "st1_status",
    "st2_payment_totals",
    "st3_occupancy",
    "i4_snapshot",
    "w8_stored_update",
    "w9_stored_no_clash",
    "w10_stored_payments",
}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - EAGER))
def test_no_cross_joins_and_no_python_in_plans(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "BatchEvalPython"):
        assert bad not in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["bus_id", "route_id", "journey_date", "total_seats", "booked_seats", "free_seats"]
    assert df.count() > 0


@pytest.fixture
def split_everything(spark):
    """Make adaptive execution treat tiny partitions as skewed and never broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100b",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def skewed_tables(spark):
    seat_rows, bookings, links = random_world(spark, 11, hot=True)
    for b in bookings:
        b["user_id"] = 1 if b["booking_id"] % 3 == 0 else b["booking_id"] % 10
        b["status"] = b["status"] or "pending"
    payments = [
        {"payment_id": i, "booking_id": 42 if i % 3 == 0 else i % 200, "transaction_id": str(i)}
        for i in range(400)
    ]
    return tables(
        spark,
        users=[{"user_id": i, "username": f"u{i}"} for i in range(10)],
        buses=[{"bus_id": i} for i in range(12)],
        routes=[{"route_id": i} for i in range(4)],
        seats=seat_rows,
        bookings=bookings,
        booking_seat=links,
        payments=payments,
    )


def skewed_log(spark):
    rows = []
    for i in range(300):
        booking = 42 if i % 3 == 0 else i % 310
        pay = i % 2 == 0
        owner = 1 if booking % 3 == 0 else booking % 10
        status = None if pay else ("cancelled" if i % 4 == 1 else "confirmed")
        rows.append((i, at(i % 50), booking, "pay" if pay else "set_status", status, "Cash", owner))
    return spark.createDataFrame(rows, LOG)


def skewed_requests(spark):
    return spark.createDataFrame(
        [(i, at(0), i % 10, 2 if i % 3 == 0 else i % 5, 1, DAY, [i, i + 1][: i % 3], "x", "y") for i in range(150)],
        "request_id long, ts timestamp_ntz, user_id long, route_id long, bus_id long, journey_date date,"
        " seats array<long>, passenger_names string, passenger_phones string",
    )


def results(spark):
    t = skewed_tables(spark)
    posted = changes.apply_changes(t, skewed_log(spark))
    created = changes.create_bookings(t, skewed_requests(spark), DAY)
    frames = [
        listings.booking_list(t, ordered=False),
        listings.user_bookings(t, ordered=False),
        listings.booking_detail_user(t),
        counters.user_booking_stats(t),
        seats.seat_map(t, seats.booked_trips(t.bookings)),
        *posted,
        *created,
    ]
    return [sorted(map(str, dicts(df))) for df in frames]


@pytest.fixture(scope="module")
def plain_results(spark):
    return results(spark)


def test_split_partitions_give_the_same_rows(spark, plain_results, split_everything):
    assert results(spark) == plain_results
    assert [len(r) for r in plain_results[:1]] == [sum(max(1, n) for n in _payments_per_booking().values())]


def _payments_per_booking():
    counts = {b: 0 for b in range(300)}
    for i in range(400):
        counts[42 if i % 3 == 0 else i % 200] += 1
    return counts


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_json_of_a_hot_bus_is_cut(spark, split_everything):
    t = skewed_tables(spark)
    made = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 1L ELSE id % 12 END AS bus_id", "id % 4 AS route_id",
        "date_add(DATE'2024-01-01', CAST(id AS INT)) AS journey_date",
    )
    df = seats.seat_map_json(t, made)
    assert "skew=true" in final_plan(df)
    assert df.count() == made.join(t.seats.select("bus_id").distinct(), "bus_id").count()


def test_holds_of_a_hot_route_and_day_are_cut(spark, split_everything):
    t = skewed_tables(spark)
    hot = t.bookings.filter("false").unionByName(
        spark.createDataFrame(
            [tuple(getattr(r, c) if c != "route_id" else 1 for c in t.bookings.columns) for r in t.bookings.collect()],
            t.bookings.schema,
        ).withColumn("journey_date", F.lit(DAY))
    )
    t = Tables(**{**t.__dict__, "bookings": hot})
    asked = spark.createDataFrame([(1, 1, DAY), (2, 1, DAY)], "bus_id long, route_id long, journey_date date")
    df = seats.live_holds(t, asked)
    assert "skew=true" in final_plan(df)
    assert df.count() == seats.live_holds(t).count()


def test_sign_ups_under_one_name_are_cut(spark, split_everything):
    forms = spark.range(2000).selectExpr(
        "id AS reg_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts",
        "CASE WHEN id % 2 = 0 THEN 'u1' ELSE concat('n', id) END AS username", "'F' AS first_name", "'L' AS last_name",
        "concat('m', id) AS email",
    )
    users = skewed_tables(spark).users.withColumn("email", F.concat(F.lit("x"), "user_id"))
    keyed = forms.select("reg_id", F.lower("username").alias("name_key"))
    known = stored(signups._known(users, "username", keyed, "name_key"), "known")
    plan = final_plan(keyed.join(known.withColumn("name_known", F.lit(1)), "name_key", "left"))
    assert "skew=true" in plan
    assert signups.admit_users(users, forms).users.count() == 10 + 1000


def test_flags_split_into_hits_and_misses(spark):
    t = skewed_tables(spark)
    pairs = t.bookings.select("booking_id", "bus_id", "route_id")
    links = spark.createDataFrame([(1, 1), (1, 1), (2, 3)], "bus_id long, route_id long")
    got = filters.with_assignment(pairs, links)
    assert got.count() == pairs.count()
    for r in got.collect():
        assert r["is_assigned"] == ((r["bus_id"], r["route_id"]) in {(1, 1), (2, 3)})


def test_newest_bookings_are_cut_before_names_are_joined(spark):
    t = skewed_tables(spark)
    plan = listings.recent_bookings(t)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda text: min(i for i, line in enumerate(lines) if text in line)
    assert depth("Join Inner") < max(i for i, line in enumerate(lines) if "GlobalLimit" in line) < depth("Join LeftSemi")
