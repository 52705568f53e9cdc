"""Row selection: catalogue look-ups, route search predicates, booking filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.functions.text import contains_pattern, is_empty, same_text, sanitize, text_key


def lookup(df: DataFrame, key: str, ids: DataFrame | Iterable[int]) -> DataFrame:
    """Rows whose key is asked for, by a short list of ids or by a frame holding them."""
    if isinstance(ids, DataFrame):
        # Distinct keys combine before the shuffle; a semi join cannot cut a hot key on its right side.
        return df.join(ids.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def active_routes(routes: DataFrame, ids: DataFrame | Iterable[int] | None = None) -> DataFrame:
    active = routes.filter(F.col("is_active") == 1)
    return active if ids is None else lookup(active, "route_id", ids)


def active_buses(buses: DataFrame) -> DataFrame:
    return buses.filter(F.col("is_active") == 1)


def passengers(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_admin") == 0)


def _holds(column: str, wanted: str | None):
    """Substring test without regard to case and accents, which an empty search text switches off."""
    text = sanitize(F.lit(wanted).cast("string"))
    return is_empty(text) | F.like(text_key(F.col(column)), contains_pattern(text_key(text)))


def matching_routes(
    routes: DataFrame, origin: str | None = None, destination: str | None = None
) -> DataFrame:
    return active_routes(routes).filter(
        _holds("origin_city", origin) & _holds("destination_city", destination)
    )


def filter_bookings(
    bookings: DataFrame,
    status: str | None = None,
    journey_date: str | dt.date | None = None,
) -> DataFrame:
    """Bookings of one status and/or one exact journey day; the date prunes partitions.

    A text that is no date matches nothing.
    """
    tests = [F.lit(True)]
    if status:
        # Said apart, as the comparison itself is nothing a scan can be asked for.
        tests.append(F.col("status").isNotNull() & same_text(F.col("status"), status))
    if journey_date:
        tests.append(F.col("journey_date") == F.lit(journey_date).try_cast("date"))
    return bookings.filter(reduce(and_, tests))


def owned_by(bookings: DataFrame, viewer: int | DataFrame) -> DataFrame:
    """A viewer's own bookings.

    With a frame of ``(booking_id, user_id)`` view requests, the bookings that
    the asking user owns, each once.
    """
    if isinstance(viewer, DataFrame):
        asked = viewer.select("booking_id", "user_id")
        return bookings.join(asked, ["booking_id", "user_id"], "left_semi")
    return bookings.filter(F.col("user_id") == viewer)


def assigned_buses(bus_route: DataFrame) -> DataFrame:
    """The buses of each route as one sorted list, for ``array_contains`` tests."""
    return bus_route.groupBy("route_id").agg(F.sort_array(F.collect_set("bus_id")).alias("bus_ids"))


def with_assignment(pairs: DataFrame, bus_route: DataFrame) -> DataFrame:
    """Flag ``(bus_id, route_id)`` pairs by whether the bus serves the route."""
    key, links = ["bus_id", "route_id"], bus_route.select("bus_id", "route_id")
    hits = pairs.join(links, key, "left_semi").withColumn("is_assigned", F.lit(True))
    return hits.unionByName(pairs.join(links, key, "left_anti").withColumn("is_assigned", F.lit(False)))
