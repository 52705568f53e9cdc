import datetime as dt
from decimal import Decimal

from fareline.operators import listings
from tests.tiny import DAY, dicts, small_world


def pay(payment_id, booking_id, **more):
    return {"payment_id": payment_id, "booking_id": booking_id, "transaction_id": f"T{payment_id}", **more}


def test_two_payments_repeat_the_booking(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1}, {"booking_id": 2}, {"booking_id": 3, "user_id": 8}],
        payments=[pay(10, 1), pay(11, 1, payment_method="bKash")],
    )
    got = [(r["booking_id"], r["payment_method"]) for r in listings.booking_list(t).collect()]
    assert sorted(got, key=str) == [(1, "Cash"), (1, "bKash"), (2, None)]
    mine = [(r["booking_id"], r["transaction_id"]) for r in listings.user_bookings(t, 1).collect()]
    assert sorted(mine, key=str) == [(1, "T10"), (1, "T11"), (2, None)]
    everybody = listings.user_bookings(t).collect()
    assert sorted(r["booking_id"] for r in everybody) == [1, 1, 2, 3]


def test_lists_are_newest_first_with_the_id_as_tie_break(spark):
    days = {1: DAY, 2: dt.date(2024, 1, 5), 3: DAY, 4: dt.date(2023, 1, 1)}
    t = small_world(
        spark,
        bookings=[{"booking_id": b, "created_at": day} for b, day in days.items()],
        payments=[pay(1, 3)],
    )
    assert [r["booking_id"] for r in listings.booking_list(t).collect()] == [2, 3, 1, 4]
    assert [r["booking_id"] for r in listings.user_bookings(t).collect()] == [2, 3, 1, 4]
    assert [r["booking_id"] for r in listings.recent_bookings(t, 3).collect()] == [2, 3, 1]


def test_recent_bookings_skip_rows_without_partner_before_the_cut(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1}, {"booking_id": 2}, {"booking_id": 3, "route_id": 77}],
    )
    assert [r["booking_id"] for r in listings.recent_bookings(t, 2).collect()] == [2, 1]


def test_filtered_list(spark):
    t = small_world(
        spark,
        bookings=[
            {"booking_id": 1, "status": "confirmed"},
            {"booking_id": 2},
            {"booking_id": 3, "status": "confirmed", "journey_date": dt.date(2024, 2, 1)},
        ],
        payments=[pay(1, 1), pay(2, 2)],
    )
    got = dicts(listings.booking_list(t, "confirmed", DAY))
    assert [(r["booking_id"], r["payment_amount"]) for r in got] == [(1, Decimal("10.00"))]


def test_details_name_both_creation_dates(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1, "created_at": dt.date(2024, 2, 2)}],
        booking_seat=[{"booking_id": 1, "seat_id": s} for s in (2, 1)],
    )
    admin = dicts(listings.booking_detail_admin(t, [1]))
    assert len(admin) == 1
    assert admin[0]["booking_created_at"] == dt.date(2024, 2, 2)
    assert admin[0]["route_created_at"] == DAY
    assert admin[0]["seat_numbers"] == "A1, A2"
    assert admin[0]["fare"] == Decimal("10.00") and admin[0]["email"] == "ann@x"
    assert dicts(listings.booking_detail_admin(t, [2])) == []


def test_user_detail_takes_the_first_payment_of_own_bookings(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1}, {"booking_id": 2, "user_id": 5}, {"booking_id": 3}],
        payments=[pay(8, 1, payment_method="late"), pay(7, 1, payment_method="early")],
    )
    got = {r["booking_id"]: r for r in dicts(listings.booking_detail_user(t, 1))}
    assert set(got) == {1, 3}
    assert (got[1]["payment_method"], got[1]["transaction_id"]) == ("early", "T7")
    assert got[3]["payment_status"] is None and got[3]["seat_numbers"] == ""
    assert dicts(listings.booking_detail_user(t, 1, [2])) == []


def test_checkout(spark):
    t = small_world(
        spark,
        bookings=[{"booking_id": 1, "total_amount": Decimal("30.00")}, {"booking_id": 2, "user_id": 4}],
        booking_seat=[{"booking_id": 1, "seat_id": 1}],
    )
    got = dicts(listings.checkout_summary(t, user_id=1))
    assert [(r["booking_id"], r["seat_numbers"], r["total_amount"]) for r in got] == [
        (1, "A1", Decimal("30.00"))
    ]


def test_route_buses_are_active_only(spark):
    t = small_world(
        spark,
        buses=[{"bus_id": 1}, {"bus_id": 2, "is_active": 0}],
        bus_route=[{"bus_id": b, "route_id": r} for b, r in ((1, 1), (2, 1), (1, 2))],
    )
    got = sorted((r["route_id"], r["bus_id"]) for r in listings.route_buses(t).collect())
    assert got == [(1, 1), (2, 1)]
    assert [r["route_id"] for r in listings.route_buses(t, [2]).collect()] == [2]
