import datetime as dt
from decimal import Decimal

from fareline.operators import audits, counters
from tests.tiny import dicts, small_world, tables


def test_empty_tables_give_zeros(spark):
    t = tables(spark)
    kpis = dicts(counters.dashboard_kpis(t))
    assert len(kpis) == 1 and set(kpis[0].values()) == {0}
    assert dicts(counters.user_counters(t)) == [
        {"shown_users": 0, "active_users": 0, "inactive_users": 0, "all_bookings": 0}
    ]
    for empty in (
        counters.user_stats(t),
        counters.user_booking_stats(t),
        counters.bus_list(t),
        counters.route_list(t),
        counters.search_routes(t.routes, t.bus_route),
        audits.payment_findings(t),
    ):
        assert empty.count() == 0


def test_kpis_count_every_payment(spark):
    t = small_world(
        spark,
        users=[{"user_id": 1}, {"user_id": 2, "is_admin": 1}],
        bookings=[{"booking_id": 1, "status": "cancelled"}, {"booking_id": 2}, {"booking_id": 3, "status": "confirmed"}],
        payments=[
            {"payment_id": 1, "booking_id": 1, "amount": Decimal("5.25")},
            {"payment_id": 2, "booking_id": 1, "amount": Decimal("5.25"), "payment_status": "failed"},
        ],
    )
    assert dicts(counters.dashboard_kpis(t)) == [
        {
            "total_users": 1,
            "total_buses": 1,
            "total_routes": 1,
            "total_bookings": 3,
            "pending_bookings": 1,
            "confirmed_bookings": 1,
            "total_revenue": Decimal("10.50"),
        }
    ]


def test_user_statistics(spark):
    t = small_world(
        spark,
        users=[
            {"user_id": 1},
            {"user_id": 2, "is_active": 0, "created_at": dt.date(2024, 5, 1)},
            {"user_id": 3, "is_admin": 1},
        ],
        bookings=[
            {"booking_id": 1, "status": "cancelled", "total_amount": Decimal("7.00")},
            {"booking_id": 2, "status": "confirmed"},
            {"booking_id": 3, "user_id": 3},
            {"booking_id": 4, "route_id": 77},
        ],
        payments=[{"payment_id": i, "booking_id": 2} for i in (1, 2, 3)],
    )
    stats = dicts(counters.user_stats(t))
    assert [(r["user_id"], r["total_bookings"], r["confirmed_bookings"], r["total_spent"]) for r in stats] == [
        (2, 0, 0, Decimal("0.00")),
        (1, 3, 1, Decimal("27.00")),
    ]
    assert dicts(counters.user_counters(t)) == [
        {"shown_users": 2, "active_users": 1, "inactive_users": 1, "all_bookings": 4}
    ]
    own = {r["user_id"]: r for r in dicts(counters.user_booking_stats(t))}
    # Booking 2 shows once per payment, booking 4 not at all: its route is gone.
    assert own[1] == {"user_id": 1, "list_rows": 4, "confirmed": 1, "pending": 1, "total_spent": Decimal("27.00")}
    assert own[2] == {"user_id": 2, "list_rows": 0, "confirmed": 0, "pending": 0, "total_spent": Decimal("0.00")}
    assert own[3]["pending"] == 1
    assert dicts(counters.user_booking_stats(t, 1)) == [own[1]]


def test_bus_and_route_lists(spark):
    t = small_world(
        spark,
        buses=[{"bus_id": 1}, {"bus_id": 2, "created_at": dt.date(2024, 2, 1)}],
        bus_route=[{"bus_id": 1, "route_id": 1}, {"bus_id": 1, "route_id": 5}],
        bookings=[{"booking_id": 1}, {"booking_id": 2}],
    )
    buses = [(r["bus_id"], r["seat_count"], r["route_count"]) for r in counters.bus_list(t).collect()]
    assert buses == [(2, 0, 0), (1, 2, 2)]
    routes = [(r["route_id"], r["bus_count"], r["booking_count"]) for r in counters.route_list(t).collect()]
    assert routes == [(1, 1, 2)]


def test_audits(spark):
    t = small_world(
        spark,
        buses=[{"bus_id": 1, "capacity": 3}, {"bus_id": 2, "capacity": 0}],
        bookings=[
            {"booking_id": 1, "status": "confirmed", "total_amount": Decimal("9.00")},
            {"booking_id": 2, "status": "cancelled", "bus_id": 2},
            {"booking_id": 3, "seat_count": 2, "total_amount": Decimal("20.00")},
        ],
        payments=[{"payment_id": 1, "booking_id": 2}, {"payment_id": 2, "booking_id": 2}],
    )
    assert [r["bus_id"] for r in audits.capacity_mismatch(t).collect()] == [1]
    fares = [(r["booking_id"], r["expected_amount"]) for r in audits.fare_mismatch(t).collect()]
    assert fares == [(1, Decimal("10.00"))]
    found = sorted((r["booking_id"], r["finding"]) for r in audits.payment_findings(t).collect())
    assert found == [(1, "confirmed unpaid"), (2, "cancelled paid"), (2, "paid more than once")]
    assert [r["booking_id"] for r in audits.unassigned_bus(t).collect()] == [2]


def test_same_seat_twice_in_one_booking_is_no_double_sale(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1}, {"booking_id": 2, "status": "cancelled"}],
        booking_seat=[{"booking_id": b, "seat_id": 1} for b in (1, 1, 2)],
    )
    assert audits.double_sold_seats(t).count() == 0
