"""Batches of requests applied to the tables.

Each job takes the present tables and a frame of requests and returns the new
table contents, plus the refused requests with a reason where a rule can refuse
one. A form text that its column cannot hold refuses that request and no other; of
several reasons the first is given. Within a batch the request with the greatest ``(ts, change_id)`` comes last
and wins. New ids are ``highest stored id + 1 + request id``, which needs no
global ordering.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions import fixed_values as V
from fareline.functions.display import total_fare, transaction_code
from fareline.functions.text import number, sanitize, whole_number
from fareline.operators.admission import first_come
from fareline.operators.filters import active_routes
from fareline.operators.seats import live_holds
from fareline.session import stored

# Seats are generated in runs of this length, so no row ever carries a long array.
SEAT_RUN = 1000

# Form texts of so many accepted requests are cleaned by one task.
CLEANED_ROWS = 20_000


class BusTables(NamedTuple):
    buses: DataFrame
    seats: DataFrame
    rejects: DataFrame


class EditedBuses(NamedTuple):
    buses: DataFrame
    rejects: DataFrame


class RouteTables(NamedTuple):
    routes: DataFrame
    bus_route: DataFrame
    rejects: DataFrame


class Deletion(NamedTuple):
    kept: DataFrame
    rejects: DataFrame


class NewBookings(NamedTuple):
    bookings: DataFrame
    booking_seat: DataFrame
    rejects: DataFrame


class PostedPayments(NamedTuple):
    payments: DataFrame
    bookings: DataFrame
    rejects: DataFrame


def change_order() -> Column:
    return F.struct("ts", "change_id")


def _next_id(df: DataFrame, key: str) -> Column:
    return F.coalesce(df.agg(F.max(key)).scalar(), F.lit(-1)) + 1


def _day(as_of: str | dt.date) -> Column:
    return F.lit(as_of).cast("date")


def _clean(*names: str) -> list[Column]:
    return [sanitize(F.col(name)).alias(name) for name in names]


def _spread(requests: DataFrame, n_rows: int) -> DataFrame:
    """Over tasks by the number of rows: files of requests are small, but their texts take long to clean."""
    n_tasks = -(-n_rows // CLEANED_ROWS)
    return requests.repartition(n_tasks, "request_id") if n_tasks > 1 else requests


def _int(name: str) -> Column:
    """A whole number from form text, NULL where the column cannot hold it."""
    return whole_number(F.col(name).cast("string")).try_cast("int").alias(name)


def _judged(requests: DataFrame, reasons: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """The requests whose parsed columns all hold a value, and the others with a reason."""
    reason = F.coalesce(*[F.when(F.col(name).isNull(), why) for name, why in reasons.items()])
    judged = requests.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    return good, judged.filter(F.col("reason").isNotNull()).select(key, "reason")


def _ticked(name: str) -> Column:
    """A checkbox: absent means 0, any value means 1."""
    return F.when(F.col(name).isNull(), 0).otherwise(1).alias(name)


def _latest(changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return changes.groupBy(key).agg(F.max_by(F.struct(*fields), change_order()).alias("edit"))


def _overwrite(df: DataFrame, latest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    merged = df.join(latest, key, "left")
    edited = F.col("edit").isNotNull()
    changed = {
        f: F.when(edited, F.col(f"edit.{f}")).otherwise(F.col(f)).cast(df.schema[f].dataType)
        for f in fields
    }
    return merged.withColumns(changed).select(*df.columns)


# ---- buses ------------------------------------------------------------------


def add_buses(buses: DataFrame, seats: DataFrame, new: DataFrame, as_of: str | dt.date) -> BusTables:
    """Add buses from form text and number their seats; no capacity gives no seats."""
    parsed = new.select(
        "request_id", *_clean("bus_number", "bus_model", "license_plate"), _int("capacity")
    )
    requests, rejects = _judged(parsed, {"capacity": V.REASON_CAPACITY}, "request_id")
    added = requests.withColumn("bus_id", _next_id(buses, "bus_id") + F.col("request_id"))
    all_buses = buses.unionByName(
        added.select(
            "bus_id",
            "bus_number",
            "bus_model",
            "license_plate",
            "capacity",
            F.lit(1).alias("is_active"),
            _day(as_of).alias("created_at"),
        )
    )
    widest = requests.agg(F.max("capacity")).scalar().cast("long")
    first_seat = _next_id(seats, "seat_id")
    capacity = F.col("capacity")
    runs = added.filter(capacity >= 1).select(
        "request_id",
        "bus_id",
        "capacity",
        F.explode(F.sequence(F.lit(0), F.floor((capacity - 1) / SEAT_RUN).cast("int"))).alias("run"),
    )
    start = F.col("run") * SEAT_RUN + 1
    numbered = runs.select(
        "request_id",
        "bus_id",
        F.explode(F.sequence(start, F.least(start + SEAT_RUN - 1, capacity))).alias("i"),
    )
    new_seats = numbered.select(
        (first_seat + F.col("request_id") * widest + F.col("i") - 1).alias("seat_id"),
        "bus_id",
        F.concat(F.lit(V.SEAT_PREFIX), F.col("i").cast("string")).alias("seat_number"),
    )
    return BusTables(all_buses, seats.unionByName(new_seats), rejects)


def edit_buses(buses: DataFrame, edits: DataFrame) -> EditedBuses:
    """Overwrite the edited buses; their seats stay as they are."""
    fields = ["bus_number", "bus_model", "license_plate", "capacity", "is_active"]
    parsed = edits.select(
        "bus_id",
        "ts",
        "change_id",
        *_clean("bus_number", "bus_model", "license_plate"),
        _int("capacity"),
        _ticked("is_active"),
    )
    good, rejects = _judged(parsed, {"capacity": V.REASON_CAPACITY}, "change_id")
    return EditedBuses(_overwrite(buses, _latest(good, "bus_id", fields), "bus_id", fields), rejects)


def _delete_unbooked(
    df: DataFrame, key: str, bookings: DataFrame, ids: DataFrame, reason: str
) -> Deletion:
    asked, booked = ids.select(key).distinct(), bookings.select(key).distinct()
    rejects = asked.join(booked, key, "left_semi").withColumn("reason", F.lit(reason))
    return Deletion(df.join(asked.join(booked, key, "left_anti"), key, "left_anti"), rejects)


def delete_buses(buses: DataFrame, bookings: DataFrame, ids: DataFrame) -> Deletion:
    """Delete the asked buses that no booking uses; seats and assignments stay."""
    return _delete_unbooked(buses, "bus_id", bookings, ids, V.REASON_BUS_BOOKED)


# ---- routes -----------------------------------------------------------------

ROUTE_TEXT = ["route_name", "origin_city", "destination_city"]


def _fare(name: str) -> Column:
    """An amount from form text, NULL where the column cannot hold it."""
    return F.round(number(F.col(name).cast("string")), 2).try_cast("decimal(10,2)").alias(name)


ROUTE_REASONS = {"distance": V.REASON_DISTANCE, "fare": V.REASON_FARE}


def add_routes(
    routes: DataFrame, bus_route: DataFrame, new: DataFrame, as_of: str | dt.date
) -> RouteTables:
    """Add routes from form text together with their bus assignments."""
    parsed = new.select(
        "request_id",
        (_next_id(routes, "route_id") + F.col("request_id")).alias("route_id"),
        *_clean(*ROUTE_TEXT),
        _int("distance"),
        _fare("fare"),
        "travel_time",
        "departure_time",
        F.lit(1).alias("is_active"),
        _day(as_of).alias("created_at"),
        "buses",
    )
    added, rejects = _judged(parsed, ROUTE_REASONS, "request_id")
    links = added.select(F.explode("buses").alias("bus_id"), "route_id")
    return RouteTables(
        routes.unionByName(added.drop("buses", "request_id")), bus_route.unionByName(links), rejects
    )


def edit_routes(routes: DataFrame, bus_route: DataFrame, edits: DataFrame) -> RouteTables:
    """Overwrite the submitted columns of the edited routes and replace their assignments.

    ``edits`` has ``route_id``, ``ts``, ``change_id``, ``is_active`` (NULL means not
    ticked), ``buses`` and any of the other route columns.
    """
    parsers = {
        **{name: sanitize(F.col(name)).alias(name) for name in ROUTE_TEXT},
        "distance": _int("distance"),
        "fare": _fare("fare"),
        "travel_time": F.col("travel_time"),
        "departure_time": F.col("departure_time"),
    }
    fields = [name for name in parsers if name in edits.columns] + ["is_active"]
    parsed = edits.select(
        "route_id",
        "ts",
        "change_id",
        *[parsers[name] for name in fields if name in parsers],
        _ticked("is_active"),
        "buses",
    )
    reasons = {name: why for name, why in ROUTE_REASONS.items() if name in fields}
    good, rejects = _judged(parsed, reasons, "change_id") if reasons else (parsed, None)
    if rejects is None:
        rejects = parsed.filter(F.lit(False)).select("change_id", F.lit("").alias("reason"))
    latest = _latest(good, "route_id", [*fields, "buses"])
    kept = bus_route.join(latest.select("route_id"), "route_id", "left_anti")
    links = latest.select(F.explode("edit.buses").alias("bus_id"), "route_id")
    return RouteTables(
        _overwrite(routes, latest, "route_id", fields),
        kept.select("bus_id", "route_id").unionByName(links),
        rejects,
    )


def delete_routes(routes: DataFrame, bookings: DataFrame, ids: DataFrame) -> Deletion:
    """Delete the asked routes that no booking uses; assignments stay."""
    return _delete_unbooked(routes, "route_id", bookings, ids, V.REASON_ROUTE_BOOKED)


# ---- users ------------------------------------------------------------------


def set_user_active(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Switch users on and off; a text that is no number of the column's range changes nothing."""
    parsed = changes.select("user_id", "ts", "change_id", _int("is_active")).filter(F.col("is_active").isNotNull())
    return _overwrite(users, _latest(parsed, "user_id", ["is_active"]), "user_id", ["is_active"])


# ---- bookings and payments --------------------------------------------------


def apply_status(bookings: DataFrame, changes: DataFrame) -> DataFrame:
    """Give each booking its last requested status; any text is accepted.

    Changes to unknown bookings have no effect.
    """
    parsed = changes.select(
        "booking_id", "ts", "change_id", sanitize(F.col("new_status")).alias("status")
    )
    latest = _latest(parsed, "booking_id", ["status"])
    return _overwrite(bookings, latest, "booking_id", ["status"])


class AddedBookings(NamedTuple):
    """What a batch of requests adds, and the refused ones."""

    bookings: DataFrame
    booking_seat: DataFrame
    rejects: DataFrame


def added_bookings(
    routes: DataFrame, next_id: Column, requests: DataFrame, as_of: str | dt.date, held: DataFrame | None = None
) -> AddedBookings:
    """The new rows of a batch of requests; ids are ``next_id + request_id``.

    ``held``: the seats that live bookings hold, by route and day. Then a request that asks
    for one of them, or for a seat of an earlier accepted request, is refused as a whole.
    """
    fares = active_routes(routes).select("route_id", "fare")
    asked = requests.join(fares, "route_id", "left").withColumn(
        "n", F.when(F.col("seats").isNull(), 0).otherwise(F.size("seats"))
    )
    amount = total_fare(F.col("fare"), F.col("n")).try_cast("decimal(12,2)")
    reason = (
        F.when(F.col("fare").isNull(), V.REASON_ROUTE)
        .when(F.col("n") == 0, V.REASON_NO_SEAT)
        .when(amount.isNull(), V.REASON_AMOUNT)
    )
    # Stored, as all three results read it.
    checked = stored(asked.withColumn("reason", reason), "checked-requests")
    if held is not None:
        sound = checked.filter(F.col("reason").isNull())
        with_order = sound.select("request_id", F.struct("ts", "request_id").alias("at"), "route_id", "journey_date", "seats")
        fits = stored(first_come(with_order, held), "fitting-requests").withColumn("fits", F.lit(1))
        clash = F.when(F.col("fits").isNull(), V.REASON_SEAT)
        checked = stored(
            checked.join(fits, "request_id", "left").withColumn("reason", F.coalesce("reason", clash)).drop("fits"),
            "checked-requests",
        )
    accepted = checked.filter(F.col("reason").isNull()).withColumn("booking_id", next_id + F.col("request_id"))
    added = _spread(accepted, accepted.count()).select(
        "booking_id",
        "user_id",
        "route_id",
        "bus_id",
        _day(as_of).alias("booking_date"),
        "journey_date",
        F.lit(V.STATUS_PENDING).alias("status"),
        F.col("n").alias("seat_count"),
        F.col("n").alias("total_passengers"),
        amount.alias("total_amount"),
        _day(as_of).alias("created_at"),
        *_clean("passenger_names", "passenger_phones"),
    )
    links = accepted.select("booking_id", F.explode("seats").alias("seat_id"))
    return AddedBookings(added, links, checked.filter(F.col("reason").isNotNull()).select("request_id", "reason"))


def create_bookings(t, requests: DataFrame, as_of: str | dt.date, refuse_clashes: bool = False) -> NewBookings:
    """Turn requests into pending bookings with their seats.

    A request needs an active route and at least one seat. A bus that serves the route is
    not asked for, and free seats are with ``refuse_clashes`` alone; the audits report both.
    """
    held = live_holds(t, requests) if refuse_clashes else None
    new = added_bookings(t.routes, _next_id(t.bookings, "booking_id"), requests, as_of, held)
    return NewBookings(
        t.bookings.unionByName(new.bookings), t.booking_seat.unionByName(new.booking_seat), new.rejects
    )


def payable(pays: DataFrame, bookings: DataFrame) -> DataFrame:
    """Payment requests whose user owns the booking, with the amount due."""
    due = bookings.select("booking_id", "user_id", "total_amount")
    return pays.join(due, ["booking_id", "user_id"])


def posted_payments(accepted: DataFrame, next_id: Column) -> DataFrame:
    """The payment rows of accepted requests, as :func:`payable` gives them."""
    number_ = F.col("change_id")
    return accepted.select(
        (next_id + number_).alias("payment_id"),
        "booking_id",
        "user_id",
        F.col("total_amount").alias("amount"),
        *_clean("payment_method"),
        transaction_code(F.col("ts"), number_).alias("transaction_id"),
        F.lit(V.PAYMENT_COMPLETED).alias("payment_status"),
    )


def refused_payments(pays: DataFrame, accepted: DataFrame) -> DataFrame:
    # Against the accepted requests, not the bookings: a small batch stays small.
    return pays.join(accepted.select("change_id"), "change_id", "left_anti").select(
        "change_id", F.lit(V.REASON_BOOKING).alias("reason")
    )


def post_payments(t, pays: DataFrame) -> PostedPayments:
    """Record payments of the stored total and confirm the bookings, whatever their status."""
    accepted = stored(payable(pays, t.bookings), "accepted-payments")  # all three results read it
    added = posted_payments(accepted, _next_id(t.payments, "payment_id"))
    confirmations = accepted.withColumn("new_status", F.lit(V.STATUS_CONFIRMED))
    return PostedPayments(
        t.payments.unionByName(added), apply_status(t.bookings, confirmations), refused_payments(pays, accepted)
    )


def apply_changes(t, log: DataFrame) -> PostedPayments:
    """Apply status changes and payments of one log together, in the order of the log."""
    posted = post_payments(t, log.filter(F.col("kind") == "pay"))
    return posted._replace(bookings=apply_status(t.bookings, effective_status(log, t.bookings)))


def effective_status(log: DataFrame, bookings: DataFrame) -> DataFrame:
    """The status each entry of a log asks for.

    Entries for unknown bookings and payments by somebody else are left out; a
    payment asks for ``confirmed``.
    """
    owners = bookings.select("booking_id", F.col("user_id").alias("owner_id"))
    return effective_entries(log.join(owners, "booking_id"))


def effective_entries(known: DataFrame) -> DataFrame:
    """:func:`effective_status` of entries that have the ``owner_id`` of their booking."""
    is_pay = F.col("kind") == "pay"
    return known.filter(~is_pay | (F.col("user_id") == F.col("owner_id"))).select(
        "booking_id",
        "ts",
        "change_id",
        F.when(is_pay, V.STATUS_CONFIRMED).otherwise(F.col("new_status")).alias("new_status"),
    )
