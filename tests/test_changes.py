import datetime as dt
from decimal import Decimal

from fareline.functions import fixed_values as V
from fareline.operators import audits, changes, counters, filters, seats
from tests.tiny import DAY, dicts, frame, small_world

AS_OF = dt.date(2024, 6, 1)


def at(minute):
    return dt.datetime(2024, 5, 1, 10, minute)


def by(df, key):
    rows = dicts(df)
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


def test_add_buses_numbers_seats(spark):
    t = small_world(spark)
    new = spark.createDataFrame(
        [
            (0, " <b>N</b>1 ", "M&M", "LP1", "2 seats"),
            (1, "N2", "M", "LP2", "0"),
            (2, "N3", "M", "LP3", "-4"),
            (3, "N4", "M", "LP4", "2500"),
        ],
        "request_id long, bus_number string, bus_model string, license_plate string, capacity string",
    )
    out = changes.add_buses(t.buses, t.seats, new, AS_OF)
    buses = by(out.buses, "bus_id")
    assert set(buses) == {1, 2, 3, 4, 5}
    assert buses[2]["bus_number"] == "N1" and buses[2]["bus_model"] == "M&amp;M"
    assert (buses[2]["is_active"], buses[2]["created_at"], buses[4]["capacity"]) == (1, AS_OF, -4)
    seats = dicts(out.seats)
    assert len({s["seat_id"] for s in seats}) == len(seats) == 2 + 2 + 2500
    per_bus = {}
    for s in seats:
        per_bus.setdefault(s["bus_id"], set()).add(s["seat_number"])
    assert set(per_bus) == {1, 2, 5}
    assert per_bus[5] == {f"A{i}" for i in range(1, 2501)}


def test_add_buses_to_empty_tables(spark):
    new = spark.createDataFrame(
        [(0, "N", "M", "LP", "1")],
        "request_id long, bus_number string, bus_model string, license_plate string, capacity string",
    )
    out = changes.add_buses(frame(spark, "buses", []), frame(spark, "seats", []), new, AS_OF)
    assert [r["bus_id"] for r in out.buses.collect()] == [0]
    assert dicts(out.seats) == [{"seat_id": 0, "bus_id": 0, "seat_number": "A1"}]


def test_edit_buses_last_edit_wins(spark):
    t = small_world(spark, buses=[{"bus_id": 1}, {"bus_id": 2}])
    edits = spark.createDataFrame(
        [
            (1, at(5), 1, "late", "M", "L", "7", None),
            (2, at(1), 1, "early", "M", "L", "9", "on"),
            (3, at(1), 77, "nobody", "M", "L", "9", "on"),
        ],
        "change_id long, ts timestamp_ntz, bus_id long, bus_number string, bus_model string,"
        " license_plate string, capacity string, is_active string",
    )
    got = by(changes.edit_buses(t.buses, edits).buses, "bus_id")
    assert set(got) == {1, 2}
    assert (got[1]["bus_number"], got[1]["capacity"], got[1]["is_active"]) == ("late", 7, 0)
    assert (got[2]["bus_number"], got[2]["is_active"]) == ("B", 1)
    assert changes.edit_buses(t.buses, edits).buses.schema == t.buses.schema


def test_delete_guard(spark):
    t = small_world(spark, buses=[{"bus_id": i} for i in (1, 2, 3)], bookings=[{"booking_id": 1}])
    asked = spark.createDataFrame([(1,), (2,), (2,), (9,)], "bus_id long")
    out = changes.delete_buses(t.buses, t.bookings, asked)
    assert sorted(r["bus_id"] for r in out.kept.collect()) == [1, 3]
    assert dicts(out.rejects) == [{"bus_id": 1, "reason": V.REASON_BUS_BOOKED}]
    routes = changes.delete_routes(t.routes, t.bookings, spark.createDataFrame([(1,)], "route_id long"))
    assert routes.kept.count() == 1
    assert dicts(routes.rejects) == [{"route_id": 1, "reason": V.REASON_ROUTE_BOOKED}]


def test_add_routes(spark):
    t = small_world(spark)
    new = spark.createDataFrame(
        [
            (0, "<i>N</i>", "O", "D", "120 km", "99.999", "01:00:00", "08:00:00", [4, 5]),
            (1, "P", "O", "D", "far", "free", None, "08:00:00", None),
        ],
        "request_id long, route_name string, origin_city string, destination_city string, distance string,"
        " fare string, travel_time string, departure_time string, buses array<long>",
    )
    out = changes.add_routes(t.routes, t.bus_route, new, AS_OF)
    got = by(out.routes, "route_id")
    assert (got[2]["route_name"], got[2]["distance"], got[2]["fare"]) == ("N", 120, Decimal("100.00"))
    assert (got[3]["distance"], got[3]["fare"], got[3]["is_active"]) == (0, Decimal("0.00"), 1)
    links = sorted((r["bus_id"], r["route_id"]) for r in out.bus_route.collect())
    assert links == [(1, 1), (4, 2), (5, 2)]


def test_edit_routes_replaces_assignments(spark):
    t = small_world(
        spark,
        routes=[{"route_id": 1}, {"route_id": 2}, {"route_id": 3}],
        bus_route=[{"bus_id": 1, "route_id": r} for r in (1, 2, 3)],
    )
    edits = spark.createDataFrame(
        [
            (1, at(1), 1, Decimal("20.00"), "1", [8]),
            (2, at(2), 1, Decimal("30.00"), None, [6, 7]),
            (3, at(1), 2, Decimal("40.00"), "1", []),
        ],
        "change_id long, ts timestamp_ntz, route_id long, fare decimal(10,2), is_active string, buses array<long>",
    )
    out = changes.edit_routes(t.routes, t.bus_route, edits)
    got = by(out.routes, "route_id")
    assert [(got[i]["fare"], got[i]["is_active"]) for i in (1, 2, 3)] == [
        (Decimal("30.00"), 0),
        (Decimal("40.00"), 1),
        (Decimal("10.00"), 1),
    ]
    assert got[1]["route_name"] == "R"
    assert sorted((r["route_id"], r["bus_id"]) for r in out.bus_route.collect()) == [(1, 6), (1, 7), (3, 1)]


def test_user_toggle(spark):
    t = small_world(spark, users=[{"user_id": 1}, {"user_id": 2}])
    log = spark.createDataFrame(
        [(1, at(3), 1, "0"), (2, at(1), 1, "1"), (3, at(1), 9, "0")],
        "change_id long, ts timestamp_ntz, user_id long, is_active string",
    )
    got = by(changes.set_user_active(t.users, log), "user_id")
    assert {k: r["is_active"] for k, r in got.items()} == {1: 0, 2: 1}


def test_status_changes(spark):
    t = small_world(spark, bookings=[{"booking_id": i} for i in (1, 2, 3, 4)])
    log = spark.createDataFrame(
        [
            (1, at(3), 1, "cancelled"),
            (2, at(1), 1, "confirmed"),
            (3, at(1), 2, "<b>on hold</b>"),
            (5, at(2), 3, "second"),
            (4, at(2), 3, "first"),
            (6, at(1), 4, None),
            (7, at(1), 99, "cancelled"),
        ],
        "change_id long, ts timestamp_ntz, booking_id long, new_status string",
    )
    got = by(changes.apply_status(t.bookings, log), "booking_id")
    assert {k: r["status"] for k, r in got.items()} == {1: "cancelled", 2: "on hold", 3: "second", 4: ""}


def test_create_bookings(spark):
    t = small_world(
        spark,
        routes=[{"route_id": 1, "fare": Decimal("12.50")}, {"route_id": 2, "is_active": 0}],
        bookings=[{"booking_id": 10}],
        booking_seat=[{"booking_id": 10, "seat_id": 1}],
    )
    requests = spark.createDataFrame(
        [
            (0, at(0), 1, 1, 1, DAY, [1, 2], " <i>Ann</i>\nBob ", None),
            (1, at(0), 1, 2, 1, DAY, [1], "x", "y"),
            (2, at(0), 1, 77, 1, DAY, [], "x", "y"),
            (3, at(0), 1, 1, 1, DAY, [], "x", "y"),
            (4, at(0), 1, 1, 1, DAY, None, "x", "y"),
        ],
        "request_id long, ts timestamp_ntz, user_id long, route_id long, bus_id long, journey_date date,"
        " seats array<long>, passenger_names string, passenger_phones string",
    )
    out = changes.create_bookings(t, requests, AS_OF)
    got = by(out.bookings, "booking_id")
    assert set(got) == {10, 11}
    new = got[11]
    assert (new["status"], new["seat_count"], new["total_passengers"]) == ("pending", 2, 2)
    assert (new["total_amount"], new["booking_date"]) == (Decimal("25.00"), AS_OF)
    assert (new["passenger_names"], new["passenger_phones"]) == ("Ann\nBob", "")
    # A seat that is held already is sold again; the audit reports it.
    links = sorted((r["booking_id"], r["seat_id"]) for r in out.booking_seat.collect())
    assert links == [(10, 1), (11, 1), (11, 2)]
    assert {r["request_id"]: r["reason"] for r in dicts(out.rejects)} == {
        1: V.REASON_ROUTE,
        2: V.REASON_ROUTE,
        3: V.REASON_NO_SEAT,
        4: V.REASON_NO_SEAT,
    }
    assert out.bookings.schema.fieldNames() == t.bookings.schema.fieldNames()


LOG = (
    "change_id long, ts timestamp_ntz, booking_id long, kind string, new_status string,"
    " payment_method string, user_id long"
)


def log_world(spark):
    t = small_world(
        spark,
        bookings=[
            {"booking_id": 1, "status": "cancelled", "total_amount": Decimal("44.00")},
            {"booking_id": 2},
            {"booking_id": 3, "user_id": 6},
        ],
        payments=[{"payment_id": 5, "booking_id": 2}],
    )
    log = spark.createDataFrame(
        [
            (1, at(1), 1, "pay", None, "<b>bKash</b>", 1),
            (2, at(2), 1, "pay", None, "Cash", 1),
            (3, at(1), 2, "pay", None, "Cash", 1),
            (4, at(2), 2, "set_status", "cancelled", None, None),
            (5, at(1), 3, "pay", None, "Cash", 1),
            (6, at(1), 9, "pay", None, "Cash", 1),
            (7, at(1), 9, "set_status", "pending", None, None),
        ],
        LOG,
    )
    return t, log


def test_payments(spark):
    t, log = log_world(spark)
    out = changes.post_payments(t, log.filter("kind = 'pay'"))
    pays = by(out.payments, "payment_id")
    assert set(pays) == {5, 7, 8, 9}
    assert (pays[7]["amount"], pays[7]["payment_method"]) == (Decimal("44.00"), "bKash")
    assert pays[7]["transaction_id"] == "TXN202405011001001001"
    assert pays[7]["payment_status"] == "completed"
    statuses = {k: r["status"] for k, r in by(out.bookings, "booking_id").items()}
    assert statuses == {1: "confirmed", 2: "confirmed", 3: "pending"}
    rejected = {r["change_id"]: r["reason"] for r in dicts(out.rejects)}
    assert rejected == {5: V.REASON_BOOKING, 6: V.REASON_BOOKING}


def test_one_log_of_status_changes_and_payments(spark):
    t, log = log_world(spark)
    out = changes.apply_changes(t, log)
    statuses = {k: r["status"] for k, r in by(out.bookings, "booking_id").items()}
    assert statuses == {1: "confirmed", 2: "cancelled", 3: "pending"}
    assert out.payments.count() == 4


def test_bad_values_refuse_their_own_request_only(spark):
    t = small_world(spark, routes=[{"route_id": 1, "fare": Decimal("99999999.99")}])
    buses = "bus_number string, bus_model string, license_plate string, capacity string"
    new = spark.createDataFrame(
        [(0, "N", "M", "L", "99999999999"), (1, "N", "M", "L", "-99999999999"), (2, "N", "M", "L", "3")],
        f"request_id long, {buses}",
    )
    out = changes.add_buses(t.buses, t.seats, new, AS_OF)
    assert set(by(out.buses, "bus_id")) == {1, 4} and out.seats.count() == 2 + 3
    assert {r["request_id"] for r in dicts(out.rejects)} == {0, 1}
    assert {r["reason"] for r in dicts(out.rejects)} == {V.REASON_CAPACITY}
    edits = spark.createDataFrame(
        [(1, at(1), 1, "good", "M", "L", "7", "1"), (2, at(2), 1, "bad", "M", "L", "2147483648", "1")],
        f"change_id long, ts timestamp_ntz, bus_id long, {buses}, is_active string",
    )
    edited = changes.edit_buses(t.buses, edits)
    assert by(edited.buses, "bus_id")[1]["bus_number"] == "good"
    assert dicts(edited.rejects) == [{"change_id": 2, "reason": V.REASON_CAPACITY}]
    routes = spark.createDataFrame(
        [(0, "N", "O", "D", "1", "1e9", None, "08:00:00", [1]), (1, "N", "O", "D", "1e10", "1", None, "08:00:00", [1]),
         (2, "N", "O", "D", "5", "99999999.99", None, "08:00:00", [1])],
        "request_id long, route_name string, origin_city string, destination_city string, distance string,"
        " fare string, travel_time string, departure_time string, buses array<long>",
    )
    added = changes.add_routes(t.routes, t.bus_route, routes, AS_OF)
    assert set(by(added.routes, "route_id")) == {1, 4}
    assert sorted((r["bus_id"], r["route_id"]) for r in added.bus_route.collect()) == [(1, 1), (1, 4)]
    assert {r["request_id"]: r["reason"] for r in dicts(added.rejects)} == {0: V.REASON_FARE, 1: V.REASON_DISTANCE}
    route_edits = spark.createDataFrame(
        [(1, at(1), 1, "20", "1", [8]), (2, at(2), 1, "1e9", "1", [9])],
        "change_id long, ts timestamp_ntz, route_id long, fare string, is_active string, buses array<long>",
    )
    rerouted = changes.edit_routes(t.routes, t.bus_route, route_edits)
    assert by(rerouted.routes, "route_id")[1]["fare"] == Decimal("20.00")
    assert [r["bus_id"] for r in rerouted.bus_route.collect()] == [8]
    assert dicts(rerouted.rejects) == [{"change_id": 2, "reason": V.REASON_FARE}]
    no_fare = changes.edit_routes(t.routes, t.bus_route, route_edits.drop("fare"))
    assert dicts(no_fare.rejects) == [] and no_fare.routes.count() == 1


def test_a_total_out_of_range_is_refused(spark):
    t = small_world(spark, routes=[{"route_id": 1, "fare": Decimal("99999999.99")}])
    many = list(range(200))
    requests = spark.createDataFrame(
        [(0, at(0), 1, 1, 1, DAY, many, "x", "y"), (1, at(0), 1, 1, 1, DAY, many[:2], "x", "y")],
        "request_id long, ts timestamp_ntz, user_id long, route_id long, bus_id long, journey_date date,"
        " seats array<long>, passenger_names string, passenger_phones string",
    )
    out = changes.create_bookings(t, requests, AS_OF)
    assert dicts(out.rejects) == [{"request_id": 0, "reason": V.REASON_AMOUNT}]
    assert [r["total_amount"] for r in dicts(out.bookings)] == [Decimal("199999999.98")]


def test_status_compares_without_case(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1, "status": "Cancelled"}, {"booking_id": 2, "status": "CONFIRMED"}],
        booking_seat=[{"booking_id": 1, "seat_id": 1}, {"booking_id": 2, "seat_id": 2}],
    )
    assert [r["booking_id"] for r in dicts(seats.live_holds(t))] == [2]
    assert dicts(counters.dashboard_kpis(t))[0]["confirmed_bookings"] == 1
    assert [r["booking_id"] for r in dicts(filters.filter_bookings(t.bookings, "confirmed"))] == [2]
    assert {(r["booking_id"], r["finding"]) for r in dicts(audits.payment_findings(t))} == {(2, "confirmed unpaid")}
