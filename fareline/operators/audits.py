"""Reports on rules that the stored data can break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.functions.display import total_fare
from fareline.functions.fixed_values import STATUS_CANCELLED, STATUS_CONFIRMED
from fareline.functions.text import same_text
from fareline.operators.counters import bus_list
from fareline.operators.seats import live_holds


def double_sold_seats(t) -> DataFrame:
    """Seats that more than one live booking holds for a route and date."""
    return (
        live_holds(t)
        .groupBy("seat_id", "route_id", "journey_date")
        .agg(F.count_distinct("booking_id").alias("holders"))
        .filter(F.col("holders") > 1)
    )


def capacity_mismatch(t) -> DataFrame:
    """Buses whose seat rows differ from the stated capacity."""
    return (
        bus_list(t, ordered=False)
        .filter(F.col("seat_count") != F.col("capacity"))
        .select("bus_id", "bus_number", "capacity", "seat_count")
    )


def fare_mismatch(t) -> DataFrame:
    """Bookings whose stored total differs from the present fare times the seats."""
    expected = total_fare(F.col("fare"), F.col("seat_count"))
    return (
        t.bookings.select("booking_id", "route_id", "seat_count", "total_amount")
        .join(t.routes.select("route_id", "fare"), "route_id")
        .withColumn("expected_amount", expected)
        .filter(F.col("total_amount") != F.col("expected_amount"))
    )


def payment_findings(t) -> DataFrame:
    """One row per booking and finding: unpaid though confirmed, paid though cancelled, paid twice."""
    paid = t.payments.groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("n_payments"), F.sum("amount").cast("decimal(18,2)").alias("paid")
    )
    checked = (
        t.bookings.select("booking_id", "status", "total_amount")
        .join(paid, "booking_id", "left")
        .withColumn("n_payments", F.coalesce("n_payments", F.lit(0)).cast("long"))
        .withColumn("paid", F.coalesce("paid", F.lit(0)).cast("decimal(18,2)"))
    )
    status, n = F.col("status"), F.col("n_payments")
    findings = F.array_compact(
        F.array(
            F.when(same_text(status, STATUS_CONFIRMED) & (n == 0), "confirmed unpaid"),
            F.when(same_text(status, STATUS_CANCELLED) & (n > 0), "cancelled paid"),
            F.when(n > 1, "paid more than once"),
        )
    )
    return checked.withColumn("finding", F.explode(findings))


def unassigned_bus(t) -> DataFrame:
    """Bookings on a bus that does not serve their route."""
    return t.bookings.select("booking_id", "bus_id", "route_id", "status").join(
        t.bus_route.select("bus_id", "route_id"), ["bus_id", "route_id"], "left_anti"
    )
