"""Counters, per-entity statistics, route search results and short lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.fixed_values import STATUS_CONFIRMED, STATUS_PENDING
from fareline.functions.text import same_text, text_key
from fareline.functions.display import joined
from fareline.operators.filters import active_buses, active_routes, matching_routes, passengers
from fareline.operators.listings import newest_first

def _rows() -> Column:
    return F.count(F.lit(1))


def _is(status: str) -> Column:
    return same_text(F.col("status"), status)


def _sum_money(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(18,2)")


def _zero_if_missing(df: DataFrame, counts: list[str], sums: list[str] = ()) -> DataFrame:
    for name in counts:
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))
    for name in sums:
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)"))
    return df


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row aggregates side by side: stack them, then sum over the gaps."""
    names = [name for part in parts for name in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.sum(name).alias(name) for name in names])


def dashboard_kpis(t, kept=None) -> DataFrame:
    """Seven figures in one row; revenue counts every payment.

    ``kept``: a booking store whose totals are read instead of the bookings and payments.
    """
    if kept is None:
        bookings = t.bookings.agg(
            _rows().alias("total_bookings"),
            F.count_if(_is(STATUS_PENDING)).alias("pending_bookings"),
            F.count_if(_is(STATUS_CONFIRMED)).alias("confirmed_bookings"),
        )
        revenue = t.payments.agg(_sum_money("amount").alias("total_revenue"))
    else:
        names = {"total_bookings": "total_bookings", "pending": "pending_bookings", "confirmed": "confirmed_bookings"}
        bookings = kept.totals("user_totals").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items()]
        )
        revenue = kept.totals("payment_totals").select(F.coalesce("revenue", F.lit(0)).alias("total_revenue"))
    row = _one_row(
        [
            passengers(t.users).agg(_rows().alias("total_users")),
            t.buses.agg(_rows().alias("total_buses")),
            t.routes.agg(_rows().alias("total_routes")),
            bookings,
            revenue,
        ]
    )
    return row.withColumn("total_revenue", F.col("total_revenue").cast("decimal(18,2)"))


def _booking_totals(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("user_id").agg(
        _rows().alias("total_bookings"),
        F.count_if(_is(STATUS_CONFIRMED)).alias("confirmed_bookings"),
        _sum_money("total_amount").alias("total_spent"),
    )


def user_stats(t, ordered: bool = True, kept=None) -> DataFrame:
    """Passengers with their bookings, confirmed bookings and total spent.

    ``kept``: a booking store whose totals are read instead of the bookings.
    """
    if kept is None:
        totals = _booking_totals(t.bookings)
    else:
        totals = kept.totals("user_totals").select(
            "user_id", "total_bookings", F.col("confirmed").alias("confirmed_bookings"), "total_spent"
        )
    out = passengers(t.users).join(totals, "user_id", "left")
    out = _zero_if_missing(out, ["total_bookings", "confirmed_bookings"], ["total_spent"])
    return newest_first(out, "user_id") if ordered else out


def user_counters(t) -> DataFrame:
    """Passengers shown, active and inactive; the bookings of admins count too."""
    active = F.col("is_active")
    return _one_row(
        [
            passengers(t.users).agg(
                _rows().alias("shown_users"),
                F.count_if(active == 1).alias("active_users"),
                F.count_if(active == 0).alias("inactive_users"),
            ),
            t.bookings.agg(_rows().alias("all_bookings")),
        ]
    )


def _users_with_bookings(users: DataFrame, stats: DataFrame) -> DataFrame:
    out = users.select("user_id").join(stats, "user_id", "left")
    return _zero_if_missing(out, ["list_rows", "confirmed", "pending"], ["total_spent"])


def user_booking_stats(t, user_id: int | None = None, kept=None) -> DataFrame:
    """Per user: rows of the booking list, confirmed, pending and total spent.

    A booking takes one list row per payment, at least one, and none when its
    route or bus is gone; payments are counted per booking before they are joined.
    ``kept``: a booking store whose totals are read instead of bookings and payments.
    """
    users, bookings = t.users, t.bookings
    if user_id is not None:
        users, bookings = (df.filter(F.col("user_id") == user_id) for df in (users, bookings))
    if kept is not None:
        return _users_with_bookings(users, kept.totals("user_totals").drop("total_bookings"))
    paid = t.payments.groupBy("booking_id").agg(_rows().alias("n_payments"))
    counted = (
        bookings.select("booking_id", "user_id", "route_id", "bus_id", "status", "total_amount")
        .join(t.buses.select("bus_id", F.lit(1).alias("has_bus")), "bus_id", "left")
        .join(t.routes.select("route_id", F.lit(1).alias("has_route")), "route_id", "left")
        .join(paid, "booking_id", "left")
    )
    shown = F.col("has_bus").isNotNull() & F.col("has_route").isNotNull()
    stats = counted.groupBy("user_id").agg(
        F.sum(F.when(shown, F.coalesce("n_payments", F.lit(1))).otherwise(0)).alias("list_rows"),
        F.count_if(_is(STATUS_CONFIRMED)).alias("confirmed"),
        F.count_if(_is(STATUS_PENDING)).alias("pending"),
        _sum_money("total_amount").alias("total_spent"),
    )
    return _users_with_bookings(users, stats)


def bus_list(t, ordered: bool = True) -> DataFrame:
    """Buses with the seats they really have and the routes they serve."""
    seats = t.seats.groupBy("bus_id").agg(_rows().alias("seat_count"))
    routes = t.bus_route.groupBy("bus_id").agg(_rows().alias("route_count"))
    out = t.buses.join(seats, "bus_id", "left").join(routes, "bus_id", "left")
    out = _zero_if_missing(out, ["seat_count", "route_count"])
    return newest_first(out, "bus_id") if ordered else out


def _buses_per_route(bus_route: DataFrame, name: str) -> DataFrame:
    return bus_route.groupBy("route_id").agg(_rows().alias(name))


def route_list(t, ordered: bool = True, kept=None) -> DataFrame:
    """Routes with their assigned buses and bookings.

    ``kept``: a booking store whose totals are read instead of the bookings.
    """
    if kept is None:
        bookings = t.bookings.groupBy("route_id").agg(_rows().alias("booking_count"))
    else:
        bookings = kept.totals("route_totals")
    out = t.routes.join(_buses_per_route(t.bus_route, "bus_count"), "route_id", "left").join(
        bookings, "route_id", "left"
    )
    out = _zero_if_missing(out, ["bus_count", "booking_count"])
    return newest_first(out, "route_id") if ordered else out


def available_buses(routes: DataFrame, bus_route: DataFrame) -> DataFrame:
    """Attach the number of assigned buses, inactive ones included."""
    out = routes.join(_buses_per_route(bus_route, "available_buses"), "route_id", "left")
    return _zero_if_missing(out, ["available_buses"])


def search_routes(
    routes: DataFrame,
    bus_route: DataFrame,
    origin: str | None = None,
    destination: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Active routes by part of the city names, in order of departure."""
    found = available_buses(matching_routes(routes, origin, destination), bus_route)
    return found.orderBy("departure_time", "route_id") if ordered else found


def search_results(
    t, origin: str | None = None, destination: str | None = None, ordered: bool = True
) -> DataFrame:
    """Found routes with the number of assigned buses and the numbers of the active ones."""
    found = search_routes(t.routes, t.bus_route, origin, destination, ordered=False)
    served = t.bus_route.join(active_buses(t.buses).select("bus_id", "bus_number"), "bus_id")
    in_order = F.sort_array(F.collect_list(F.struct("bus_id", "bus_number")))
    numbers = served.groupBy("route_id").agg(joined(in_order["bus_number"]).alias("bus_numbers"))
    out = found.join(numbers, "route_id", "left").withColumn("bus_numbers", F.coalesce("bus_numbers", F.lit("")))
    return out.orderBy("departure_time", "route_id") if ordered else out


def search_count(
    routes: DataFrame, origin: str | None = None, destination: str | None = None
) -> DataFrame:
    return matching_routes(routes, origin, destination).agg(_rows().alias("routes_found"))


def popular_routes(routes: DataFrame, n: int = 5) -> DataFrame:
    """The active routes with the lowest ids."""
    return active_routes(routes).orderBy("route_id").limit(n)


def cities(routes: DataFrame) -> DataFrame:
    """Every city a route starts or ends in, in one pass over the routes.

    Spellings that differ in case or accents are one city, shown by the first in code-point order.
    """
    both = routes.select(F.explode(F.array("origin_city", "destination_city")).alias("city"))
    return both.groupBy(text_key(F.col("city"))).agg(F.min("city").alias("city")).select("city").orderBy("city")
