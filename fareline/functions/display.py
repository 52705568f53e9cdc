"""Display formats and labels, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareline.functions import fixed_values as V
from fareline.functions.text import capitalise, is_empty


def date_text(c: Column) -> Column:
    """``05 Mar 2024``."""
    return F.date_format(c, "dd MMM yyyy")


def time_text(c: Column) -> Column:
    """``HH:mm:ss`` as a 12-hour clock: ``09:05 PM``."""
    moment = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), c))
    return F.date_format(moment, "hh:mm a")


def grouped(c: Column, places: int) -> Column:
    """Thousands separators and fixed decimals, halves rounded away from zero.

    Adding zero turns a negative zero into a plain one.
    """
    return F.format_number(F.round(c, places) + F.lit(0), places)


def money(c: Column) -> Column:
    return F.concat(F.lit(V.CURRENCY), grouped(c, 2))


def status_label(c: Column) -> Column:
    return (
        F.when(c == V.STATUS_CONFIRMED, V.LABEL_SUCCESS)
        .when(c == V.STATUS_PENDING, V.LABEL_WARNING)
        .otherwise(V.LABEL_DANGER)
    )


def payment_label(payment_status: Column) -> Column:
    return F.when(is_empty(payment_status), V.LABEL_NOT_PAID).otherwise(capitalise(payment_status))


def paid_via(payment_status: Column, method: Column) -> Column:
    """NULL where nothing is paid: the list then shows no badge."""
    paid = F.concat(F.lit(V.LABEL_PAID_VIA), F.coalesce(method, F.lit("")))
    return F.when(~is_empty(payment_status), paid)


def paid_or_pending(payment_status: Column) -> Column:
    return F.when(is_empty(payment_status), V.LABEL_PENDING).otherwise(V.LABEL_PAID)


def active_label(is_active: Column) -> Column:
    return F.when(is_active != 0, V.LABEL_ACTIVE).otherwise(V.LABEL_INACTIVE)


def or_missing(c: Column) -> Column:
    return F.when(is_empty(c), V.LABEL_MISSING).otherwise(c)


def journey(origin: Column, destination: Column) -> Column:
    return F.concat(F.coalesce(origin, F.lit("")), F.lit(V.ARROW), F.coalesce(destination, F.lit("")))


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def total_fare(fare: Column, seats: Column) -> Column:
    """Wide enough for every fare and number of seats that can be stored."""
    return (fare * seats).cast("decimal(20,2)")


def not_past(c: Column, as_of: Column) -> Column:
    return c >= as_of


def _four_digits(number: Column) -> Column:
    return (F.pmod(number, F.lit(9000)) + 1000).cast("string")


def transaction_code(ts: Column, number: Column) -> Column:
    return F.concat(
        F.lit(V.TRANSACTION_PREFIX), F.date_format(ts, "yyyyMMddHHmmss"), _four_digits(number)
    )


def booking_code(day: Column, number: Column) -> Column:
    return F.concat(F.lit(V.BOOKING_PREFIX), F.date_format(day, "yyyyMMdd"), _four_digits(number))
