"""Booking lists and details joined with passenger, route, bus and payment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.operators.filters import active_buses, filter_bookings, lookup, owned_by
from fareline.operators.seats import booking_seat_numbers

ROUTE_NAMES = ["route_id", "route_name", "origin_city", "destination_city"]
ROUTE_DETAIL = [
    "route_id",
    "route_name",
    "origin_city",
    "destination_city",
    "distance",
    "fare",
    "travel_time",
    "departure_time",
    "is_active",
]


def with_payments(bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Left join on ``booking_id`` that repeats a booking for each of its payments.

    Written as paid rows plus unpaid rows: when one booking holds very many
    payments an inner join can be cut on that side, which a left join cannot.
    Both branches read the same shuffle of the bookings, which is why the test for
    a key (never missing) stands in front of both.
    """
    keyed = bookings.filter(F.col("booking_id").isNotNull())
    paid = keyed.join(payments, "booking_id")
    unpaid = keyed.join(payments.select("booking_id").distinct(), "booking_id", "left_anti")
    return paid.unionByName(unpaid, allowMissingColumns=True)


def _of_bookings(df: DataFrame, bookings: DataFrame, chosen: bool) -> DataFrame:
    """Where bookings were chosen, only their rows.

    A semi join with few bookings broadcasts them and leaves the large table where it is.
    """
    return lookup(df, "booking_id", bookings) if chosen else df


def newest_first(df: DataFrame, key: str, created: str = "created_at") -> DataFrame:
    return df.orderBy(F.col(created).desc(), F.col(key).desc())


def booking_list(
    t,
    status: str | None = None,
    journey_date: str | dt.date | None = None,
    ordered: bool = True,
    more_of_route: Sequence[str] = (),
    more_of_user: Sequence[str] = (),
) -> DataFrame:
    """All bookings with passenger, route, bus and payment, and further columns on request."""
    bookings = filter_bookings(t.bookings, status, journey_date)
    payments = _of_bookings(t.payments, bookings, bool(journey_date)).select(
        "booking_id", "payment_status", "payment_method", F.col("amount").alias("payment_amount")
    )
    out = (
        with_payments(bookings, payments)
        .join(t.buses.select("bus_id", "bus_number"), "bus_id")
        .join(t.routes.select(*ROUTE_NAMES, *more_of_route), "route_id")
        .join(t.users.select("user_id", "username", "email", *more_of_user), "user_id")
    )
    return newest_first(out, "booking_id") if ordered else out


def user_bookings(t, user_id: int | None = None, ordered: bool = True) -> DataFrame:
    """One user's bookings, or everybody's, with route, bus and payment."""
    mine = t.bookings if user_id is None else owned_by(t.bookings, user_id)
    payments = _of_bookings(t.payments, mine, user_id is not None).select(
        "booking_id", "payment_status", "payment_method", "transaction_id"
    )
    out = (
        with_payments(mine, payments)
        .join(t.buses.select("bus_id", "bus_number", "bus_model"), "bus_id")
        .join(t.routes.select(*ROUTE_NAMES, "departure_time"), "route_id")
    )
    return newest_first(out, "booking_id") if ordered else out


def _chosen(
    t, ids: DataFrame | Iterable[int] | None, user_id: int | None = None
) -> tuple[DataFrame, bool]:
    """The asked bookings, and whether that is a choice at all."""
    bookings = t.bookings if user_id is None else owned_by(t.bookings, user_id)
    if ids is not None:
        bookings = lookup(bookings, "booking_id", ids)
    return bookings, ids is not None or user_id is not None


def _with_route_and_bus(bookings: DataFrame, t) -> DataFrame:
    """Both tables carry ``created_at``; the names say whose it is."""
    return (
        bookings.withColumnRenamed("created_at", "booking_created_at")
        .join(t.buses.select("bus_id", "bus_number", "bus_model"), "bus_id")
        .join(
            t.routes.select(*ROUTE_DETAIL, F.col("created_at").alias("route_created_at")), "route_id"
        )
    )


def _with_seat_numbers(df: DataFrame, t, bookings: DataFrame, chosen: bool) -> DataFrame:
    named = booking_seat_numbers(_of_bookings(t.booking_seat, bookings, chosen), t.seats)
    return df.join(named, "booking_id", "left").withColumn(
        "seat_numbers", F.coalesce("seat_numbers", F.lit(""))
    )


def booking_detail_admin(t, ids: DataFrame | Iterable[int] | None = None) -> DataFrame:
    """Booking with passenger contact, route, bus, seats and the fare of today."""
    bookings, chosen = _chosen(t, ids)
    detail = _with_route_and_bus(bookings, t).join(
        t.users.select("user_id", "username", "email", "phone_number"), "user_id"
    )
    return _with_seat_numbers(detail, t, bookings, chosen)


def first_payment(payments: DataFrame) -> DataFrame:
    """The earliest payment row of each booking."""
    details = F.struct("payment_status", "payment_method", "transaction_id")
    first = payments.groupBy("booking_id").agg(F.min_by(details, "payment_id").alias("p"))
    return first.select("booking_id", "p.*")


def booking_detail_user(
    t, user_id: int | None = None, ids: DataFrame | Iterable[int] | None = None
) -> DataFrame:
    """Booking with route, bus, first payment and seats; only the user's own."""
    mine, chosen = _chosen(t, ids, user_id)
    payments = first_payment(_of_bookings(t.payments, mine, chosen))
    detail = _with_route_and_bus(mine, t).join(payments, "booking_id", "left")
    return _with_seat_numbers(detail, t, mine, chosen)


def checkout_summary(
    t, ids: DataFrame | Iterable[int] | None = None, user_id: int | None = None
) -> DataFrame:
    """What a passenger sees before paying."""
    mine, chosen = _chosen(t, ids, user_id)
    summary = mine.join(t.buses.select("bus_id", "bus_number", "bus_model"), "bus_id").join(
        t.routes.select(*ROUTE_NAMES, "departure_time"), "route_id"
    )
    return _with_seat_numbers(summary, t, mine, chosen)


def route_buses(t, route_ids: DataFrame | Iterable[int] | None = None) -> DataFrame:
    """The active buses that serve each route."""
    links = t.bus_route if route_ids is None else lookup(t.bus_route, "route_id", route_ids)
    return links.join(active_buses(t.buses), "bus_id")


def recent_bookings(t, n: int = 5, kept=None) -> DataFrame:
    """The newest ``n`` bookings with passenger, route and bus.

    Bookings whose partner is missing drop out before the cut, by their keys alone; the
    names are joined to the ``n`` rows that are left. ``kept``: a booking store that is read
    newest days first instead of all bookings.
    """

    def whole(bookings: DataFrame) -> DataFrame:
        for table, key in ((t.buses, "bus_id"), (t.routes, "route_id"), (t.users, "user_id")):
            bookings = bookings.join(table.select(key), key, "left_semi")
        return bookings

    if kept is None:
        newest = newest_first(whole(t.bookings), "booking_id").limit(n)
    else:
        newest = kept.newest_bookings(n, whole)
    named = (
        newest.join(t.buses.select("bus_id", "bus_number"), "bus_id")
        .join(t.routes.select("route_id", "route_name"), "route_id")
        .join(t.users.select("user_id", "username"), "user_id")
    )
    return newest_first(named, "booking_id")
