"""Seats for requests in order of arrival, against going through them one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fareline.functions import fixed_values as V
from fareline.operators import admission, audits, changes, seats
from fareline.sources.tables import Tables
from tests.tiny import DAY, dicts, small_world

REQUESTS = (
    "request_id long, ts timestamp_ntz, user_id long, route_id long, bus_id long, journey_date date,"
    " seats array<long>, passenger_names string, passenger_phones string"
)
NEXT = DAY + dt.timedelta(days=1)


def at(minute):
    return dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)


def one_by_one(requests, held):
    """``(request_id, ts, route, day, seats)`` in any order; ``held`` are (route, day, seat)."""
    taken, fits = set(held), set()
    for rid, _, route, day, asked in sorted(requests, key=lambda r: (r[1], r[0])):
        keys = {(route, day, s) for s in asked if s is not None}
        if route is None or day is None or not keys & taken:
            fits.add(rid)
            taken |= keys
    return fits


def admitted(spark, requests, held=()):
    rows = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], list(r[4])) for r in requests],
        "request_id long, ts long, route_id long, journey_date date, seats array<long>",
    ).withColumn("at", F.struct("ts", "request_id"))
    taken = spark.createDataFrame(list(held), "route_id long, journey_date date, seat_id long")
    found = [r["request_id"] for r in admission.first_come(rows, taken).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(6))
def test_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    n_seats, days = rng.choice([(4, 1), (9, 2), (30, 2)])
    requests = [
        (i, rng.randrange(40), rng.randrange(2), DAY if rng.randrange(days) else NEXT, rng.sample(range(n_seats), rng.randrange(0, 4)))
        for i in range(120)
    ]
    held = {(rng.randrange(2), DAY, rng.randrange(n_seats)) for _ in range(rng.randrange(5))}
    assert admitted(spark, requests, held) == one_by_one(requests, held)


def test_a_refused_request_frees_its_seats(spark):
    requests = [(1, 1, 1, DAY, [1, 2]), (2, 2, 1, DAY, [2, 3]), (3, 3, 1, DAY, [3, 4]), (4, 4, 1, DAY, [4])]
    assert admitted(spark, requests) == {1, 3}
    assert admitted(spark, requests, [(1, DAY, 1)]) == {2, 4}


def test_nulls_repeats_and_nothing(spark):
    requests = [
        (1, 1, 1, DAY, [5, None, 5]),
        (2, 2, 1, DAY, [5]),
        (3, 3, None, DAY, [5]),
        (4, 4, 1, None, [5]),
        (5, 5, 1, None, [5]),
        (6, 6, 1, DAY, []),
        (7, 6, 1, DAY, []),
        (8, 0, 1, NEXT, [5]),
        (9, None, 1, DAY, [6]),
        (10, 1, 1, DAY, [6]),
    ]
    assert admitted(spark, requests) == {1, 3, 4, 5, 6, 7, 8, 9}
    assert admitted(spark, [(1, 1, 1, DAY, [1])][:0]) == set()


def test_a_long_chain_of_conflicts(spark):
    requests = [(i, i, 1, DAY, [i, i + 1]) for i in range(45)]
    assert admitted(spark, requests) == one_by_one(requests, ()) == set(range(0, 45, 2))


def test_everybody_asks_for_one_trip(spark):
    rng = random.Random(3)
    requests = [
        (i, i, 1 if i % 3 else i % 50, DAY, rng.sample(range(40), 1 + i % 3)) for i in range(4000)
    ]
    assert admitted(spark, requests) == one_by_one(requests, ())


def world(spark):
    return small_world(
        spark,
        seats=[{"seat_id": i, "bus_id": 1, "seat_number": f"A{i}"} for i in range(1, 6)],
        bookings=[
            {"booking_id": 1, "status": "confirmed"},
            {"booking_id": 2, "status": "Cancelled"},
            {"booking_id": 3, "status": "pending", "journey_date": NEXT},
        ],
        booking_seat=[{"booking_id": 1, "seat_id": 1}, {"booking_id": 2, "seat_id": 2}, {"booking_id": 3, "seat_id": 3}],
    )


def test_create_bookings_without_clashes(spark):
    t = world(spark)
    asked = [
        (0, at(1), 1, 1, 1, DAY, [1], "held by a booking", ""),
        (1, at(2), 1, 1, 1, DAY, [2, 3], "free: cancelled, and another day", ""),
        (2, at(3), 1, 1, 1, DAY, [3, 4], "in conflict with the one before", ""),
        (3, at(4), 1, 1, 1, DAY, [4], "free again", ""),
        (4, at(0), 1, 9, 1, DAY, [5], "unknown route, holds nothing", ""),
        (5, at(5), 1, 1, 1, DAY, [5], "so this fits", ""),
        (6, at(5), 1, 1, 1, DAY, None, "no seat", ""),
        (7, at(6), 1, 1, 1, NEXT, [1], "another day", ""),
    ]
    out = changes.create_bookings(t, spark.createDataFrame(asked, REQUESTS), DAY, refuse_clashes=True)
    added = {r["booking_id"] - 4: r for r in dicts(out.bookings) if r["booking_id"] > 3}
    assert set(added) == {1, 3, 5, 7} and added[1]["seat_count"] == 2
    rejects = {r["request_id"]: r["reason"] for r in dicts(out.rejects)}
    assert rejects == {0: V.REASON_SEAT, 2: V.REASON_SEAT, 4: V.REASON_ROUTE, 6: V.REASON_NO_SEAT}
    after = Tables(**{**t.__dict__, "bookings": out.bookings, "booking_seat": out.booking_seat})
    assert audits.double_sold_seats(after).count() == 0
    # Clashes are accepted unless asked for.
    assert changes.create_bookings(t, spark.createDataFrame(asked, REQUESTS), DAY).rejects.count() == 2


def test_seat_map_agrees(spark):
    t = world(spark)
    asked = [(i, at(i), 1, 1, 1, DAY, [1 + i % 5], "", "") for i in range(20)]
    out = changes.create_bookings(t, spark.createDataFrame(asked, REQUESTS), DAY, refuse_clashes=True)
    after = Tables(**{**t.__dict__, "bookings": out.bookings, "booking_seat": out.booking_seat})
    free = [r for r in dicts(seats.seat_map(after, seats.booked_trips(after.bookings))) if r["journey_date"] == DAY and not r["is_booked"]]
    assert free == [] and out.rejects.count() == 16


def test_texts_are_cleaned_by_tasks_that_grow_in_number_with_the_requests(spark, monkeypatch):
    monkeypatch.setattr(changes, "CLEANED_ROWS", 10)
    t = small_world(spark)
    rows = [(i, at(i), 1, 1, 1, NEXT, [i], f" <b>n{i}</b>", "0") for i in range(95)]
    requests = spark.createDataFrame(rows, REQUESTS).coalesce(1)
    new = changes.added_bookings(t.routes, F.lit(1000), requests, "2024-06-01").bookings
    assert new.rdd.getNumPartitions() == 10
    got = {r["booking_id"]: r["passenger_names"] for r in new.collect()}
    assert got == {1000 + i: f"n{i}" for i in range(95)}
