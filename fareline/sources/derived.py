"""The domain tables and request batches, derived from the star-schema parquet files.

Definitions follow FIXTURES.md. Each frame is built only when it is asked for.
Row counts that set key ranges come in as scalar subqueries, so nothing is
cross joined and every derived table stays one pass over its source.

Bookings and their seats come out of joins over the largest sources, and the seats
of the buses out of an explode. They are written once per application to the shared
work folder and read back from there, as a cluster would read its stored tables;
the planner then knows their true size before it decides to broadcast one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fareline.session import fit_shuffles, work_folder
from fareline.sources.schemas import PARTITIONING, RAW, TABLES
from fareline.sources.tables import write_table, write_tables

# (application, source folder, table) -> folder the table was written to
_WRITTEN: dict[tuple[str, str, str], str] = {}

#: Bookings are for one of so many days.
JOURNEY_DAYS = 7


def _days_after(start: str, days: Column) -> Column:
    return F.date_add(F.to_date(F.lit(start)), days.cast("int"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


class DerivedTables:
    """Same attributes as :class:`fareline.sources.tables.Tables`, plus request batches."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        fit_shuffles(spark, [f"{sf_dir}/{name}.parquet" for name in RAW])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_routes(self) -> Column:
        return _row_count(self.raw("part"))

    @cached_property
    def n_buses(self) -> Column:
        return _row_count(self.raw("supplier"))

    @cached_property
    def n_orders(self) -> Column:
        return _row_count(self.raw("orders"))

    @staticmethod
    def _some_lower(key: Column, city: Column) -> Column:
        """A few cities in another spelling: in lower case, or with an accent."""
        return F.when(key % 31 == 0, F.lower(city)).when(key % 37 == 0, F.translate(city, "A", "Á")).otherwise(city)

    def _written(self, name: str, build, schema: StructType, values: int | None = None) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            folder = work_folder(self.spark, name)
            write_table(build(), folder, PARTITIONING.get(name, []), values=values)
            _WRITTEN[key] = folder
        return self.spark.read.schema(schema).parquet(_WRITTEN[key])

    @property
    def snapshot(self) -> str:
        """The folder of a snapshot of all tables, written once per application."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "snapshot")
        if key not in _WRITTEN:
            folder = work_folder(self.spark, "snapshot")
            write_tables(self, folder)
            _WRITTEN[key] = folder
        return _WRITTEN[key]

    # ---- stored tables -------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("c_mktsegment").alias("first_name"),
            F.concat(F.lit("N"), _text(F.col("c_nationkey"))).alias("last_name"),
            F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
            F.when(key % 5 == 0, None)
            .when(key % 5 == 1, "")
            .when(key % 5 == 2, "0")
            .otherwise(F.concat(F.lit("01"), F.lpad(_text(key), 9, "0")))
            .alias("phone_number"),
            F.when(key % 4 != 0, F.concat(F.lit("Street "), _text(key % 97))).alias("address"),
            _flag(key % 50 == 0).alias("is_admin"),
            _flag(F.col("c_acctbal") >= 0).alias("is_active"),
            _days_after("2020-01-01", key % 1000).alias("created_at"),
        )

    @cached_property
    def buses(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("bus_id"),
            F.col("s_name").alias("bus_number"),
            F.concat(F.lit("Model-"), _text(F.col("s_nationkey") % 4)).alias("bus_model"),
            F.concat(F.lit("LP-"), _text(key)).alias("license_plate"),
            (10 + key % 51).cast("int").alias("capacity"),
            _flag(F.col("s_acctbal") >= 0).alias("is_active"),
            _days_after("2020-01-01", key % 500).alias("created_at"),
        )

    @cached_property
    def seats(self) -> DataFrame:
        return self._written("seats", self._derive_seats, TABLES["seats"])

    def _derive_seats(self) -> DataFrame:
        # Capacity is 10 to 60 by construction, so the exploded array is short.
        last = F.when(F.col("bus_id") % 20 == 3, F.col("capacity") - 2).otherwise(F.col("capacity"))
        numbered = self.buses.select("bus_id", F.explode(F.sequence(F.lit(1), last)).alias("i"))
        return numbered.select(
            (F.col("bus_id") * 100 + F.col("i")).alias("seat_id"),
            "bus_id",
            F.concat(F.lit("A"), _text(F.col("i"))).alias("seat_number"),
        )

    @cached_property
    def routes(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        # nation holds 25 rows whatever the scale, so it fits in one map value.
        city = (
            self.raw("nation")
            .agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))))
            .scalar()
        )
        return self.raw("part").select(
            key.alias("route_id"),
            F.concat("p_name", F.lit(" #"), _text(key)).alias("route_name"),
            self._some_lower(key, F.element_at(city, (key % 25).cast("int"))).alias("origin_city"),
            F.element_at(city, ((key + 1 + size % 24) % 25).cast("int")).alias("destination_city"),
            (size * 10).alias("distance"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("fare"),
            F.when(size % 7 == 0, None)
            .otherwise(F.concat(F.lpad(_text(1 + size % 12), 2, "0"), F.lit(":30:00")))
            .alias("travel_time"),
            F.concat(
                F.lpad(_text((key * 37) % 24), 2, "0"),
                F.lit(":"),
                F.lpad(_text((key * 5) % 60), 2, "0"),
                F.lit(":00"),
            ).alias("departure_time"),
            _flag(size > 5).alias("is_active"),
            _days_after("2020-01-01", key % 700).alias("created_at"),
        )

    @cached_property
    def bus_route(self) -> DataFrame:
        key = F.col("p_partkey")
        first = key % self.n_buses
        second = F.when(key % 10 != 0, (key + 1) % self.n_buses)
        links = self.raw("part").select(
            F.explode(F.array_distinct(F.array_compact(F.array(first, second)))).alias("bus_id"),
            key.alias("route_id"),
        )
        return links

    @cached_property
    def trip(self) -> DataFrame:
        """An order as a booking header, before seats and price."""
        # No trip is on a route with id 7 modulo 40 or a bus with id 9 modulo 10: those orders
        # move to the next one, so that some routes and buses have no booking.
        key = F.col("o_orderkey")
        drawn = (key * 13 + F.col("o_custkey")) % self.n_routes
        route = F.when(drawn % 40 == 7, (drawn + 1) % self.n_routes).otherwise(drawn)
        bus = (route + key % 2) % self.n_buses
        status = (
            F.when(F.col("o_orderstatus") == "F", "confirmed")
            .when(F.col("o_orderstatus") == "O", "pending")
            .otherwise("cancelled")
        )
        return self.raw("orders").select(
            key.alias("booking_id"),
            F.col("o_custkey").alias("user_id"),
            route.alias("route_id"),
            F.when(bus % 10 == 9, (bus + 1) % self.n_buses).otherwise(bus).alias("bus_id"),
            F.to_date("o_orderdate").alias("booking_date"),
            _days_after("2024-01-01", key % JOURNEY_DAYS).alias("journey_date"),
            F.when(key % 29 == 0, F.upper(status)).otherwise(status).alias("status"),
            "o_orderpriority",
        )

    @cached_property
    def booking_seat(self) -> DataFrame:
        return self._written("booking_seat", self._derive_links, TABLES["booking_seat"])

    def _derive_links(self) -> DataFrame:
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("booking_id"), "l_linenumber")
        placed = lines.join(self.trip.select("booking_id", "bus_id"), "booking_id").join(
            self.buses.select("bus_id", "capacity"), "bus_id"
        )
        offset = (F.col("booking_id") * 7 + F.col("l_linenumber") * 3) % F.col("capacity")
        return placed.select(
            "booking_id", (F.col("bus_id") * 100 + 1 + offset).alias("seat_id")
        ).distinct()

    @cached_property
    def _priced(self) -> DataFrame:
        schema = StructType([*TABLES["bookings"].fields, StructField("o_orderpriority", StringType())])
        return self._written("bookings", self._derive_bookings, schema, values=JOURNEY_DAYS)

    def _derive_bookings(self) -> DataFrame:
        counts = self.booking_seat.groupBy("booking_id").agg(
            F.count(F.lit(1)).cast("int").alias("seat_count")
        )
        fare = F.col("fare") - F.when(F.col("booking_id") % 17 == 0, 10).otherwise(0)
        return (
            self.trip.join(counts, "booking_id")
            .join(self.routes.select("route_id", "fare"), "route_id")
            .select(
                "booking_id",
                "user_id",
                "route_id",
                "bus_id",
                "booking_date",
                "journey_date",
                "status",
                "seat_count",
                F.col("seat_count").alias("total_passengers"),
                (fare * F.col("seat_count")).cast("decimal(12,2)").alias("total_amount"),
                F.col("booking_date").alias("created_at"),
                F.when(F.col("booking_id") % 3 == 0, None)
                .otherwise(F.concat(F.lit("Pax "), _text(F.col("booking_id")), F.lit("\nGuest")))
                .alias("passenger_names"),
                F.when(F.col("booking_id") % 3 == 1, "01700000000, 01800000000").alias(
                    "passenger_phones"
                ),
                "o_orderpriority",
            )
        )

    @cached_property
    def bookings(self) -> DataFrame:
        return self._priced.select(*TABLES["bookings"].names)

    @cached_property
    def payments(self) -> DataFrame:
        key, status = F.col("booking_id"), F.lower("status")
        paid = ((status == "confirmed") & (key % 11 != 0)) | (
            (status == "cancelled") & (key % 4 == 0)
        )
        times = F.when(key % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        payment_id = key * 2 + F.col("k")
        method = (
            F.when(F.col("o_orderpriority") == "2-HIGH", "Nagad")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Credit Card")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Cash")
            .otherwise("bKash")
        )
        return (
            self._priced.filter(paid)
            .select("booking_id", "user_id", "total_amount", "o_orderpriority", F.explode(times).alias("k"))
            .select(
                payment_id.alias("payment_id"),
                "booking_id",
                "user_id",
                F.col("total_amount").alias("amount"),
                method.alias("payment_method"),
                F.concat(F.lit("TXN"), F.lpad(_text(payment_id), 14, "0")).alias("transaction_id"),
                F.lit("completed").alias("payment_status"),
            )
        )

    # ---- request batches -----------------------------------------------

    @property
    def events(self) -> DataFrame:
        return self.raw("events")

    def changes_from(self, events: DataFrame, n_bookings: Column) -> DataFrame:
        """Status and payment changes; ``events`` may be a batch or a stream."""
        kind = F.col("event_type")
        return events.filter(kind != "view").select(
            F.col("event_id").alias("change_id"),
            "ts",
            ((F.col("event_id") * 7) % n_bookings).alias("booking_id"),
            F.when(kind == "purchase", "pay").otherwise("set_status").alias("kind"),
            F.when(kind == "click", "pending")
            .when(kind == "error", "cancelled")
            .otherwise("confirmed")
            .alias("new_status"),
            F.when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "bKash").otherwise("Nagad")).alias(
                "payment_method"
            ),
            "user_id",
        )

    @cached_property
    def booking_changes(self) -> DataFrame:
        return self.changes_from(self.events, self.n_orders)

    def payers(self, changes: DataFrame) -> DataFrame:
        """Name the paying user: mostly the owner, in every fourth change the event's user."""
        owners = self.bookings.select("booking_id", F.col("user_id").alias("owner_id"))
        payer = F.when(F.col("change_id") % 4 == 0, F.col("user_id")).otherwise(
            F.coalesce("owner_id", "user_id")
        )
        return changes.join(owners, "booking_id", "left").select(
            "change_id", "ts", "booking_id", "kind", "new_status", "payment_method", payer.alias("user_id")
        )

    @cached_property
    def change_log(self) -> DataFrame:
        return self.payers(self.booking_changes)

    @cached_property
    def pay_requests(self) -> DataFrame:
        return self.payers(self.booking_changes.filter(F.col("kind") == "pay"))

    @cached_property
    def booking_requests(self) -> DataFrame:
        key = F.col("event_id")
        route = key % self.n_routes
        bus = route % self.n_buses
        n_seats, first_seat = (key % 4).cast("int"), (key % 6).cast("int")
        first = bus * 100 + 1 + first_seat
        seats = F.when(n_seats >= 1, F.sequence(first, first + n_seats - 1)).otherwise(
            F.array().cast("array<bigint>")
        )
        return self.events.filter(F.col("event_type").isin("purchase", "view")).select(
            key.alias("request_id"),
            "ts",
            "user_id",
            route.alias("route_id"),
            bus.alias("bus_id"),
            F.to_date("ts").alias("journey_date"),
            seats.alias("seats"),
            F.concat(F.lit(" <i>Pax</i> "), F.col("props"), F.lit("\nGuest ")).alias("passenger_names"),
            F.lit("01700000000").alias("passenger_phones"),
        )

    @cached_property
    def searches(self) -> DataFrame:
        """What visitors typed in to find a route: whole and partial names, wildcards, nothing."""
        key = F.col("event_id")
        origin = (
            F.when(key % 6 == 0, "")
            .when(key % 6 == 1, F.concat(F.lit(" nation_"), _text(key % 25)))
            .when(key % 6 == 2, F.concat(F.lit("N%"), _text(key % 10)))
            .when(key % 6 == 3, F.concat(F.lit("áTION_"), _text(key % 3)))
            .when(key % 6 == 4, "0")
            .otherwise(F.concat(F.lit("on\\_"), _text(key % 7)))
        )
        destination = (
            F.when(key % 5 == 0, None)
            .when(key % 5 == 1, F.concat(F.lit("_"), _text(key % 10)))
            .when(key % 5 == 2, "o")
            .when(key % 5 == 3, "nowhere")
            .otherwise(F.concat(F.lit("ion__"), _text(key % 4)))
        )
        return self.events.filter(F.col("event_type") == "view").select(
            key.alias("search_id"), origin.alias("origin"), destination.alias("destination")
        )

    @cached_property
    def registrations(self) -> DataFrame:
        key, user = F.col("event_id"), F.lpad(_text(F.col("user_id")), 9, "0")
        return self.events.filter(F.col("event_type") == "signup").select(
            key.alias("reg_id"),
            "ts",
            F.when(key % 3 == 0, F.concat(F.lit("Customer#"), user))
            .when(key % 3 == 1, F.concat(F.when(F.floor(key / 50) % 2 == 0, "new").otherwise("NÉW"), _text(key % 50)))
            .otherwise(F.concat(F.lit(" <b>u"), _text(F.floor(key / 2)), F.lit("</b> ")))
            .alias("username"),
            F.when(key % 10 == 0, "0").otherwise("First").alias("first_name"),
            F.when(key % 13 == 0, "").otherwise("Last").alias("last_name"),
            F.when(key % 8 == 0, F.concat(F.lit("customer."), user, F.lit("@example.com")))
            .otherwise(F.concat(F.lit("E"), _text(key % 701), F.lit("@example.com")))
            .alias("email"),
            F.when(key % 7 != 0, F.concat(F.lit("01"), _text(key))).alias("phone_number"),
            F.when(key % 5 != 0, F.concat(F.lit("<p>Street"), _text(key % 97))).alias("address"),
        )

    @cached_property
    def route_edits(self) -> DataFrame:
        """One edit per click, so a route may be edited several times or not at all."""
        key = F.col("event_id")
        edits = self.events.filter(F.col("event_type") == "click").select(
            key.alias("change_id"),
            "ts",
            (key % self.n_routes).alias("route_id"),
            F.concat(F.lit(" <u>Line "), _text(key)).alias("route_name"),
            F.concat(F.lit("A & "), _text(key % 9)).alias("origin_city"),
            F.concat(F.lit("B"), _text(key % 8)).alias("destination_city"),
            F.when(key % 43 == 0, "3000000000 km").otherwise(F.concat(_text(key % 900), F.lit(" km"))).alias("distance"),
            F.when(key % 41 == 0, "1e9")
            .otherwise(_text((F.col("value").cast("decimal(10,2)") + 25).cast("decimal(10,2)")))
            .alias("fare"),
            F.when(key % 6 != 0, F.lit("02:45:00")).alias("travel_time"),
            F.concat(F.lpad(_text(key % 24), 2, "0"), F.lit(":20:00")).alias("departure_time"),
            F.when(key % 18 != 0, 1).alias("is_active"),
            F.array((key + 2) % self.n_buses).alias("buses"),
        )
        return edits

    @cached_property
    def bus_edits(self) -> DataFrame:
        """One edit per error event, as submitted form text."""
        key = F.col("event_id")
        return self.events.filter(F.col("event_type") == "error").select(
            key.alias("change_id"),
            "ts",
            (key % self.n_buses).alias("bus_id"),
            F.concat(F.lit(" <b>Bus</b> "), _text(key)).alias("bus_number"),
            F.lit("Model & Co").alias("bus_model"),
            F.concat(F.lit("LP-E"), _text(key)).alias("license_plate"),
            F.when(key % 19 == 0, "99999999999 seats")
            .otherwise(F.concat(_text(10 + key % 51), F.lit(" seats")))
            .alias("capacity"),
            F.when(F.col("value") >= 10, 1).alias("is_active"),
        )

    @cached_property
    def new_buses(self) -> DataFrame:
        """A successor for every bus, as submitted form text; some without a usable capacity."""
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("request_id"),
            F.concat(F.lit(" <i>"), F.col("s_name"), F.lit("</i>-N ")).alias("bus_number"),
            F.lit("Model & Co").alias("bus_model"),
            F.concat(F.lit("LP-N"), _text(key)).alias("license_plate"),
            F.when(key % 25 == 0, "none")
            .when(key % 7 == 3, "99999999999 seats")
            .otherwise(F.concat(_text(10 + key % 51), F.lit(" seats")))
            .alias("capacity"),
        )

    @cached_property
    def new_routes(self) -> DataFrame:
        """A seasonal twin for every route, as submitted form text."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("request_id"),
            F.concat(F.lit("<em>"), F.col("p_name"), F.lit("</em> \"season\"")).alias("route_name"),
            F.concat(F.lit("From "), F.col("p_brand")).alias("origin_city"),
            F.concat(F.lit("To "), F.col("p_brand")).alias("destination_city"),
            F.concat(_text(F.col("p_size") * 10), F.lit(" km")).alias("distance"),
            F.when(key % 33 == 5, "1e9").otherwise(F.concat(_text(F.col("p_size")), F.lit(".75"))).alias("fare"),
            F.lit("01:30:00").alias("travel_time"),
            F.lit("06:15:00").alias("departure_time"),
            F.when(
                F.col("p_size") > 5, F.array(key % self.n_buses, (key + 1) % self.n_buses)
            ).alias("buses"),
        )

    @cached_property
    def user_toggles(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("change_id"),
            "ts",
            "user_id",
            F.when(F.col("event_type") == "error", "0").otherwise("1").alias("is_active"),
        )
