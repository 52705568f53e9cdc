"""Small hand-made tables: rows as dicts, missing columns filled with defaults."""

import datetime as dt
from decimal import Decimal

from fareline.sources.schemas import TABLES
from fareline.sources.tables import Tables

DAY = dt.date(2024, 1, 1)

DEFAULTS = {
    "users": {"is_admin": 0, "is_active": 1, "created_at": DAY},
    "buses": {"bus_number": "B", "capacity": 2, "is_active": 1, "created_at": DAY},
    "seats": {"seat_number": "A1"},
    "routes": {
        "route_name": "R",
        "origin_city": "Here",
        "destination_city": "There",
        "fare": Decimal("10.00"),
        "departure_time": "08:00:00",
        "is_active": 1,
        "created_at": DAY,
    },
    "bus_route": {},
    "bookings": {
        "user_id": 1,
        "route_id": 1,
        "bus_id": 1,
        "booking_date": DAY,
        "journey_date": DAY,
        "status": "pending",
        "seat_count": 1,
        "total_passengers": 1,
        "total_amount": Decimal("10.00"),
        "created_at": DAY,
    },
    "booking_seat": {},
    "payments": {
        "user_id": 1,
        "amount": Decimal("10.00"),
        "payment_method": "Cash",
        "payment_status": "completed",
    },
}


def frame(spark, name, rows):
    schema = TABLES[name]
    full = [{**DEFAULTS[name], **row} for row in rows]
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in full], schema)


def tables(spark, **rows):
    return Tables(**{name: frame(spark, name, rows.get(name, [])) for name in TABLES})


def small_world(spark, **changes):
    """One user, one bus with two seats, one route, nothing booked."""
    rows = {
        "users": [{"user_id": 1, "username": "ann", "email": "ann@x"}],
        "buses": [{"bus_id": 1}],
        "seats": [{"seat_id": 1, "bus_id": 1}, {"seat_id": 2, "bus_id": 1, "seat_number": "A2"}],
        "routes": [{"route_id": 1}],
        "bus_route": [{"bus_id": 1, "route_id": 1}],
    }
    return tables(spark, **{**rows, **changes})


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
