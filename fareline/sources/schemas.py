"""Declared schemas (never inferred) of the stored tables and of the raw star-schema files."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

FARE, AMOUNT = DecimalType(10, 2), DecimalType(12, 2)
LONG, INT, TEXT, DATE = LongType(), IntegerType(), StringType(), DateType()
REAL, MOMENT = DoubleType(), TimestampNTZType()


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, StructType] = {
    "users": _schema(
        user_id=LONG,
        username=TEXT,
        first_name=TEXT,
        last_name=TEXT,
        email=TEXT,
        phone_number=TEXT,
        address=TEXT,
        is_admin=INT,
        is_active=INT,
        created_at=DATE,
    ),
    "buses": _schema(
        bus_id=LONG,
        bus_number=TEXT,
        bus_model=TEXT,
        license_plate=TEXT,
        capacity=INT,
        is_active=INT,
        created_at=DATE,
    ),
    "seats": _schema(seat_id=LONG, bus_id=LONG, seat_number=TEXT),
    "routes": _schema(
        route_id=LONG,
        route_name=TEXT,
        origin_city=TEXT,
        destination_city=TEXT,
        distance=INT,
        fare=FARE,
        travel_time=TEXT,
        departure_time=TEXT,
        is_active=INT,
        created_at=DATE,
    ),
    "bus_route": _schema(bus_id=LONG, route_id=LONG),
    "bookings": _schema(
        booking_id=LONG,
        user_id=LONG,
        route_id=LONG,
        bus_id=LONG,
        booking_date=DATE,
        journey_date=DATE,
        status=TEXT,
        seat_count=INT,
        total_passengers=INT,
        total_amount=AMOUNT,
        created_at=DATE,
        passenger_names=TEXT,
        passenger_phones=TEXT,
    ),
    "booking_seat": _schema(booking_id=LONG, seat_id=LONG),
    "payments": _schema(
        payment_id=LONG,
        booking_id=LONG,
        user_id=LONG,
        amount=AMOUNT,
        payment_method=TEXT,
        transaction_id=TEXT,
        payment_status=TEXT,
    ),
}

# How each table is laid out on disk; tables not named here are not partitioned.
PARTITIONING: dict[str, list[str]] = {"bookings": ["journey_date"]}

# Tables that meet on a booking: bucketed alike in a catalog, they join without a shuffle.
BUCKETING: dict[str, str] = {
    "bookings": "booking_id",
    "booking_seat": "booking_id",
    "payments": "booking_id",
}

RAW: dict[str, StructType] = {
    "nation": _schema(n_nationkey=INT, n_name=TEXT, n_regionkey=INT),
    "customer": _schema(
        c_custkey=LONG, c_name=TEXT, c_nationkey=INT, c_acctbal=REAL, c_mktsegment=TEXT
    ),
    "supplier": _schema(s_suppkey=LONG, s_name=TEXT, s_nationkey=INT, s_acctbal=REAL),
    "part": _schema(
        p_partkey=LONG, p_name=TEXT, p_brand=TEXT, p_type=TEXT, p_size=INT, p_retailprice=REAL
    ),
    "orders": _schema(
        o_orderkey=LONG,
        o_custkey=LONG,
        o_orderstatus=TEXT,
        o_totalprice=REAL,
        o_orderdate=MOMENT,
        o_orderpriority=TEXT,
    ),
    "lineitem": _schema(
        l_orderkey=LONG,
        l_partkey=LONG,
        l_suppkey=LONG,
        l_linenumber=INT,
        l_quantity=REAL,
        l_extendedprice=REAL,
        l_discount=REAL,
        l_tax=REAL,
        l_returnflag=TEXT,
        l_linestatus=TEXT,
        l_shipdate=MOMENT,
    ),
    "events": _schema(
        event_id=LONG, ts=MOMENT, user_id=LONG, event_type=TEXT, value=REAL, props=TEXT
    ),
}
