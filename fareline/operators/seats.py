"""Seat availability for many trips at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.display import joined
from fareline.functions.fixed_values import STATUS_CANCELLED
from fareline.functions.text import same_text
from fareline.session import stored

TRIP = ["bus_id", "route_id", "journey_date"]
DAY = ["route_id", "journey_date"]

# Seat ids are taken in blocks of 64, so that the seats of a block fit the bits of a long.
BLOCK_BITS = 6


def _block(seat_id: Column) -> Column:
    return F.shiftright(seat_id, BLOCK_BITS)


def _place(seat_id: Column) -> Column:
    return seat_id.bitwiseAND(2**BLOCK_BITS - 1).cast("int")


def _bits(seat_id: str) -> Column:
    """The given seats of a block as one long, a bit per seat."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col(seat_id))))


def _is_booked(held: Column, seat_id: Column) -> Column:
    return F.coalesce(F.getbit(held, _place(seat_id)) == 1, F.lit(False))


def booked_trips(bookings: DataFrame) -> DataFrame:
    return bookings.select(*TRIP).distinct()


def live_holds(t, trips: DataFrame | None = None) -> DataFrame:
    """One row per seat and booking that is not cancelled; a NULL status holds nothing.

    With ``trips``, only bookings of a route and day that occurs among them.
    """
    live = t.bookings.filter(~same_text(F.col("status"), STATUS_CANCELLED))
    if trips is not None:
        live = live.join(trips.select(*DAY), DAY, "left_semi")
    return t.booking_seat.join(live.select("booking_id", "route_id", "journey_date"), "booking_id")


def _held_by_block(t, trips: DataFrame, few_trips: bool, held: DataFrame | None = None) -> DataFrame:
    """A row per trip and block of its bus's seat ids, with the present and held seats as bits.

    The held seats of a route and day become one long per block before they meet
    the trips, so shuffles carry one row per trip and block and never the trip x
    seat result. A seat belongs to one bus, so the held bits may cover other buses
    too; the present bits are the seats of this one. ``held``: the held seats by route
    and day, where they are kept already.
    """
    block = _block(F.col("seat_id")).alias("block")
    holds = live_holds(t, trips if few_trips else None) if held is None else held
    held = holds.groupBy(*DAY, block).agg(_bits("seat_id").alias("held"))
    blocks = t.seats.groupBy("bus_id", block).agg(_bits("seat_id").alias("present"))
    return trips.select(*TRIP).join(blocks, "bus_id").join(held, [*DAY, "block"], "left")


def seat_map(
    t, trips: DataFrame, ordered: bool = False, few_trips: bool = False, held: DataFrame | None = None
) -> DataFrame:
    """Every seat of every trip's bus, flagged when a live booking holds it.

    ``trips`` holds distinct ``(bus_id, route_id, journey_date)``; with ``few_trips``
    the bookings of other routes and days are left out before their seats are read.
    ``held``: the seats a booking store holds, instead of bookings and their seats.
    """
    seat_id = F.col("seat_id")
    seats = t.seats.select("seat_id", "bus_id", "seat_number", _block(seat_id).alias("block"))
    out = (
        _held_by_block(t, trips, few_trips, held)
        .join(seats, ["bus_id", "block"])
        .select(
            *TRIP, "seat_id", "seat_number", _is_booked(F.col("held"), seat_id).alias("is_booked")
        )
    )
    return out.orderBy(*TRIP, "seat_number", "seat_id") if ordered else out


def trip_occupancy(t, trips: DataFrame, few_trips: bool = False, held: DataFrame | None = None) -> DataFrame:
    """All, booked and free seats of each trip, counted block by block; ``held`` as in :func:`seat_map`."""
    taken = F.col("present").bitwiseAND(F.coalesce("held", F.lit(0).cast("long")))
    counted = _held_by_block(t, trips, few_trips, held).select(
        *TRIP, F.bit_count("present").alias("total"), F.bit_count(taken).alias("booked")
    )
    return counted.groupBy(*TRIP).agg(
        F.sum("total").alias("total_seats"),
        F.sum("booked").alias("booked_seats"),
        F.sum(F.col("total") - F.col("booked")).alias("free_seats"),
    )


def seat_map_json(t, trips: DataFrame, few_trips: bool = False) -> DataFrame:
    """One JSON document per trip, seats in text order of their number.

    Shuffles carry the bits of the held seats; the document is put together from
    the seat list of the bus in the last step.
    """
    held = F.when(F.col("held").isNotNull(), F.struct("block", "held"))
    per_trip = (
        _held_by_block(t, trips, few_trips)
        .groupBy(*TRIP)
        .agg(F.map_from_entries(F.collect_list(held)).alias("held"))
    )
    in_order = F.sort_array(F.collect_list(F.struct("seat_number", "seat_id")))
    # Stored, so that the trips of a bus with very many of them can be spread over tasks.
    lists = stored(t.seats.groupBy("bus_id").agg(in_order.alias("seats")), "seat-lists")
    as_sent = F.transform(
        "seats",
        lambda s: F.struct(
            s["seat_id"].alias("seat_id"),
            s["seat_number"].alias("seat_number"),
            _is_booked(
                F.try_element_at("held", _block(s["seat_id"])), s["seat_id"]
            ).alias("is_booked"),
        ),
    )
    return per_trip.join(lists, "bus_id").select(*TRIP, F.to_json(as_sent).alias("seats_json"))


def booking_seat_numbers(booking_seat: DataFrame, seats: DataFrame) -> DataFrame:
    """The seat numbers of each booking as one string; links without a seat drop out."""
    pairs = booking_seat.join(seats.select("seat_id", "seat_number"), "seat_id")
    in_order = F.sort_array(F.collect_list(F.struct("seat_id", "seat_number")))
    return pairs.groupBy("booking_id").agg(joined(in_order["seat_number"]).alias("seat_numbers"))
