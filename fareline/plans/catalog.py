"""Every registered query: what runs over which derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.functions import display as D
from fareline.functions import text as X
from fareline.operators import audits, changes, counters, filters, listings, searches, seats, signups
from fareline.operators.booking_store import BookingStore
from fareline.operators.catalog_store import CatalogStore
from fareline.session import stored, work_folder
from fareline.sources.derived import DerivedTables
from fareline.sources.schemas import RAW, TABLES
from fareline.sources.tables import load_tables, write_tables
from fareline.sources.versions import Version
from fareline.streaming import live

AS_OF = "2024-06-01"
SEARCH_ORIGIN, SEARCH_DESTINATION = " nation_1", "N_2"
STATUS, JOURNEY_DATE = "confirmed", "2024-01-03"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(name: str):
    def register(build: Callable[[DerivedTables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: build(DerivedTables(spark, sf_dir))
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- storage ------------------------------------------------------------


@_query("i4_snapshot")
def _(t):
    """Write all tables as a snapshot, open it again and total every table."""
    folder = work_folder(t.spark, "snapshot")
    write_tables(t, folder)
    return snapshot_totals(load_tables(t.spark, folder))


@_query("i1_load_tables")
def _(t):
    """Open stored tables under their declared schemas and total every column of them."""
    return snapshot_totals(load_tables(t.spark, t.snapshot))


def snapshot_totals(t) -> DataFrame:
    """Rows per table and a sum of row hashes over all columns, whatever the order of rows."""
    out = None
    for name, schema in TABLES.items():
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in schema.names]
        row = F.concat_ws("|", *texts)
        one = getattr(t, name).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("row_sum"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@_query("i2_domain_tables")
def _(t):
    """The derived bookings themselves, column by column."""
    return t.bookings


@_query("i2_payments")
def _(t):
    return t.payments


# ---- seats --------------------------------------------------------------


def all_trips(t) -> DataFrame:
    return seats.booked_trips(t.bookings)


@_query("a1_seat_map")
def _(t):
    return seats.seat_map(t, all_trips(t))


@_query("a1_seat_map_requested")
def _(t):
    """The seats of every trip somebody asks for, booked before or not."""
    return seats.seat_map(t, seats.booked_trips(t.booking_requests), few_trips=True)


@_query("a2_trip_occupancy")
def _(t):
    return seats.trip_occupancy(t, all_trips(t))


@_query("i3_seat_map_json")
def _(t):
    return seats.seat_map_json(t, all_trips(t))


# ---- filters ------------------------------------------------------------


@_query("p1_active_routes")
def _(t):
    return filters.active_routes(t.routes)


@_query("p1_active_routes_requested")
def _(t):
    return filters.active_routes(t.routes, t.booking_requests)


@_query("p2_active_buses")
def _(t):
    return filters.active_buses(t.buses)


@_query("p3_search_routes")
def _(t):
    return counters.search_routes(t.routes, t.bus_route, SEARCH_ORIGIN, SEARCH_DESTINATION)


@_query("p3_search_routes_open")
def _(t):
    return counters.search_routes(t.routes, t.bus_route, "", "0")


@_query("p3_search_results")
def _(t):
    """All active routes as the result page shows them, with their bus numbers."""
    return counters.search_results(t)


def _search_batch(t) -> searches.SearchBatch:
    return searches.search_batch(t.searches, t.routes, t.bus_route)


@_query("p3_search_batch")
def _(t):
    """What every different search of the visitors finds."""
    return _search_batch(t).found


@_query("p3_search_batch_counts")
def _(t):
    return searches.search_counts(_search_batch(t))


@_query("p4_filter_bookings")
def _(t):
    return filters.filter_bookings(t.bookings, STATUS, JOURNEY_DATE)


@_query("p5_lookup")
def _(t):
    return filters.lookup(t.buses, "bus_id", t.bookings)


@_query("p5_lookup_routes")
def _(t):
    return filters.lookup(t.routes, "route_id", t.bookings)


@_query("p6_passengers")
def _(t):
    return filters.passengers(t.users)


@_query("p7_assigned_buses")
def _(t):
    lists = filters.assigned_buses(t.bus_route)
    as_text = F.array_join(F.col("bus_ids").cast("array<string>"), ",")
    return lists.select("route_id", as_text.alias("bus_ids"))


@_query("p7_assignment_flags")
def _(t):
    return filters.with_assignment(all_trips(t), t.bus_route)


@_query("p8_owned_bookings")
def _(t):
    return filters.owned_by(t.bookings, t.pay_requests)


# ---- lists and details --------------------------------------------------


@_query("j1_booking_list")
def _(t):
    return listings.booking_list(t)


@_query("j1_booking_list_filtered")
def _(t):
    return listings.booking_list(t, STATUS, JOURNEY_DATE)


@_query("j2_user_bookings")
def _(t):
    return listings.user_bookings(t)


@_query("j3_detail_admin")
def _(t):
    return listings.booking_detail_admin(t)


@_query("j4_detail_user")
def _(t):
    return listings.booking_detail_user(t)


@_query("j5_seat_numbers")
def _(t):
    return seats.booking_seat_numbers(t.booking_seat, t.seats)


@_query("j6_checkout")
def _(t):
    return listings.checkout_summary(t)


@_query("j7_route_buses")
def _(t):
    return listings.route_buses(t)


# ---- counters -----------------------------------------------------------


@_query("g1_kpis")
def _(t):
    return counters.dashboard_kpis(t)


@_query("g2_user_stats")
def _(t):
    return counters.user_stats(t)


@_query("g3_user_counters")
def _(t):
    return counters.user_counters(t)


@_query("g4_user_booking_stats")
def _(t):
    return counters.user_booking_stats(t)


@_query("g5_bus_list")
def _(t):
    return counters.bus_list(t)


@_query("g6_route_list")
def _(t):
    return counters.route_list(t)


@_query("g7_available_buses")
def _(t):
    return counters.available_buses(filters.active_routes(t.routes), t.bus_route).select(
        "route_id", "available_buses"
    )


@_query("g8_search_count")
def _(t):
    return counters.search_count(t.routes, SEARCH_ORIGIN, SEARCH_DESTINATION)


@_query("t1_recent")
def _(t):
    return listings.recent_bookings(t)


@_query("t2_popular")
def _(t):
    return counters.popular_routes(t.routes)


@_query("s1_cities")
def _(t):
    return counters.cities(t.routes)


# ---- expressions --------------------------------------------------------


@_query("f0_expressions")
def _(t):
    listed = listings.booking_list(
        t,
        ordered=False,
        more_of_route=["departure_time", "fare", "is_active"],
        more_of_user=["first_name", "last_name", "phone_number"],
    )
    c = F.col
    return listed.select(
        "booking_id",
        c("payment_amount").alias("payment_amount"),
        D.date_text(c("journey_date")).alias("journey_text"),
        D.time_text(c("departure_time")).alias("departure_text"),
        D.grouped(c("total_amount"), 2).alias("total_text"),
        D.grouped(c("total_amount"), 0).alias("total_rounded"),
        D.money(c("total_amount")).alias("total_money"),
        X.capitalise(c("status")).alias("status_text"),
        D.status_label(c("status")).alias("status_label"),
        D.payment_label(c("payment_status")).alias("payment_label"),
        D.paid_via(c("payment_status"), c("payment_method")).alias("paid_via"),
        D.paid_or_pending(c("payment_status")).alias("paid_or_pending"),
        D.active_label(c("is_active")).alias("route_state"),
        D.or_missing(c("phone_number")).alias("phone"),
        X.full_name(c("first_name"), c("last_name")).alias("full_name"),
        D.journey(c("origin_city"), c("destination_city")).alias("journey"),
        X.line_breaks(c("passenger_names")).alias("names_html"),
        D.joined(F.array("username", "email")).alias("contact"),
        X.sanitize(F.concat(F.lit(" <b>\"A&B'"), c("passenger_names"), F.lit("</b>\t"))).alias("clean"),
        X.whole_number(F.concat(F.lit(" "), c("booking_id").cast("string"), F.lit(" km"))).alias("whole"),
        X.number(F.concat(c("fare").cast("string"), F.lit("x"))).alias("number"),
        D.total_fare(c("fare"), c("seat_count")).alias("fare_total"),
        D.not_past(c("journey_date"), F.lit(JOURNEY_DATE).cast("date")).alias("upcoming"),
        D.transaction_code(c("booking_date"), c("booking_id")).alias("transaction_code"),
        D.booking_code(c("booking_date"), c("booking_id")).alias("booking_code"),
        X.is_empty(c("phone_number")).alias("no_phone"),
    )


@_query("f14_markup")
def _(t):
    """Form texts with markup that is not plain: quotes, comments, nested and open tags."""
    key, k = F.col("event_id"), F.col("event_id").cast("string")

    def made(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    typed = (
        F.when(key % 8 == 0, made('a <b title="', k, ' > 1">', k, "</b> z"))
        .when(key % 8 == 1, made("x<!-- ", k, " > -- -->", k))
        .when(key % 8 == 2, made("<a <b> c>", k, " < 5"))
        .when(key % 8 == 3, made(k, " <i"))
        .when(key % 8 == 4, made("<?php if (", k, ' > 1) echo "?>" ?>', k))
        .when(key % 8 == 5, made("<!DOCTYPE html>", k, ' & "', k, '"'))
        .when(key % 8 == 6, made("<i title='never closed>", k, "</i>"))
        .otherwise(made("\t", k, "\n"))
    )
    return t.events.select("event_id", X.sanitize(typed).alias("clean"))


# ---- writes -------------------------------------------------------------


def _add_buses(t):
    return changes.add_buses(t.buses, t.seats, t.new_buses, AS_OF)


@_query("w1_add_buses")
def _(t):
    return _add_buses(t).buses


@_query("w1_add_buses_seats")
def _(t):
    return _add_buses(t).seats


@_query("w1_add_buses_rejects")
def _(t):
    return _add_buses(t).rejects


def _edit_buses(t):
    return changes.edit_buses(t.buses, t.bus_edits)


@_query("w2_edit_buses")
def _(t):
    return _edit_buses(t).buses


@_query("w2_edit_buses_rejects")
def _(t):
    return _edit_buses(t).rejects


def _delete_buses(t):
    return changes.delete_buses(t.buses, t.bookings, t.buses)


@_query("w3_delete_buses")
def _(t):
    return _delete_buses(t).kept


@_query("w3_delete_buses_rejects")
def _(t):
    return _delete_buses(t).rejects


def _add_routes(t):
    return changes.add_routes(t.routes, t.bus_route, t.new_routes, AS_OF)


@_query("w4_add_routes")
def _(t):
    return _add_routes(t).routes


@_query("w4_add_routes_assignments")
def _(t):
    return _add_routes(t).bus_route


@_query("w4_add_routes_rejects")
def _(t):
    return _add_routes(t).rejects


def _edit_routes(t):
    return changes.edit_routes(t.routes, t.bus_route, t.route_edits)


@_query("w5_edit_routes")
def _(t):
    return _edit_routes(t).routes


@_query("w5_edit_routes_assignments")
def _(t):
    return _edit_routes(t).bus_route


@_query("w5_edit_routes_rejects")
def _(t):
    return _edit_routes(t).rejects


def _delete_routes(t):
    return changes.delete_routes(t.routes, t.bookings, t.routes)


@_query("w6_delete_routes")
def _(t):
    return _delete_routes(t).kept


@_query("w6_delete_routes_rejects")
def _(t):
    return _delete_routes(t).rejects


@_query("w7_set_user_active")
def _(t):
    return changes.set_user_active(t.users, t.user_toggles)


@_query("w8_apply_status")
def _(t):
    return changes.apply_status(t.bookings, t.booking_changes)


def _create_bookings(t):
    return changes.create_bookings(t, t.booking_requests, AS_OF)


@_query("w9_create_bookings")
def _(t):
    return _create_bookings(t).bookings


@_query("w9_create_bookings_seats")
def _(t):
    return _create_bookings(t).booking_seat


@_query("w9_create_bookings_rejects")
def _(t):
    return _create_bookings(t).rejects


def _create_without_clashes(t):
    return changes.create_bookings(t, t.booking_requests, AS_OF, refuse_clashes=True)


@_query("w9_no_clash")
def _(t):
    """Requests in order of arrival; those for a taken seat are refused."""
    return _create_without_clashes(t).bookings


@_query("w9_no_clash_seats")
def _(t):
    return _create_without_clashes(t).booking_seat


@_query("w9_no_clash_rejects")
def _(t):
    return _create_without_clashes(t).rejects


def _post_payments(t):
    return changes.post_payments(t, t.pay_requests)


@_query("w10_post_payments")
def _(t):
    return _post_payments(t).payments


@_query("w10_post_payments_bookings")
def _(t):
    return _post_payments(t).bookings


@_query("w10_post_payments_rejects")
def _(t):
    return _post_payments(t).rejects


@_query("w10_apply_changes")
def _(t):
    """Status changes and payments of one log, folded together."""
    return changes.apply_changes(t, t.change_log).bookings


# ---- a booking store ----------------------------------------------------


def _new_store(t) -> BookingStore:
    return BookingStore.create(t.spark, work_folder(t.spark, "store"), t)


LOG_BATCHES = 3
# (application, source folder) -> a store and the version that holds the whole change log
_STORES: dict[tuple[str, str], tuple[BookingStore, Version]] = {}


def _changed_store(t) -> tuple[BookingStore, Version]:
    """A store that took the change log in batches of any times, then the booking requests.

    Kept once per application: versions stay as they are, so several queries read them.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORES:
        store, log = _new_store(t), stored(t.change_log, "change-log")
        for k in range(LOG_BATCHES):
            after_log = store.apply_log(log.filter(F.col("change_id") % LOG_BATCHES == k)).version
        store.add_bookings(t, t.booking_requests, AS_OF)
        _STORES[key] = (store, after_log)
    return _STORES[key]


@_query("w8_stored_update")
def _(t):
    """Bookings of a store after a batch of status changes; only their days are written."""
    store = _new_store(t)
    store.apply_status(t.booking_changes)
    return store.bookings()


@_query("w9_stored_no_clash")
def _(t):
    store = _new_store(t)
    store.add_bookings(t, t.booking_requests, AS_OF, refuse_clashes=True)
    return store.bookings()


@_query("w10_stored_changes")
def _(t):
    store, after_log = _changed_store(t)
    return store.bookings(after_log)


@_query("w10_stored_payments")
def _(t):
    store = _new_store(t)
    store.apply_log(t.change_log)
    return store.payments()


@_query("g1_kept_kpis")
def _(t):
    """Counters from totals that several batches changed, without reading a booking."""
    return counters.dashboard_kpis(t, kept=_changed_store(t)[0])


@_query("g2_kept_user_stats")
def _(t):
    return counters.user_stats(t, kept=_changed_store(t)[0])


@_query("g4_kept_user_booking_stats")
def _(t):
    return counters.user_booking_stats(t, kept=_changed_store(t)[0])


@_query("g6_kept_route_list")
def _(t):
    return counters.route_list(t, kept=_changed_store(t)[0])


@_query("t1_stored_recent")
def _(t):
    """The newest bookings of a store, read from the days that hold them."""
    return listings.recent_bookings(t, kept=_changed_store(t)[0])


@_query("w11_admit_users")
def _(t):
    return signups.admit_users(t.users, t.registrations).users


@_query("w11_admit_users_rejects")
def _(t):
    rejects = signups.admit_users(t.users, t.registrations).rejects
    return rejects.select("reg_id", F.array_join("reasons", "; ").alias("reasons"))


# ---- a catalog store ----------------------------------------------------

_CATALOGS: dict[tuple[str, str], CatalogStore] = {}


def _edited_catalog(t) -> CatalogStore:
    """A store that took the edits of buses, of routes and of users; kept once per application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _CATALOGS:
        store = CatalogStore.create(t.spark, work_folder(t.spark, "catalog"), t)
        store.edit_buses(t.bus_edits)
        store.edit_routes(t.route_edits)
        store.set_user_active(t.user_toggles)
        _CATALOGS[key] = store
    return _CATALOGS[key]


@_query("w2_stored_buses")
def _(t):
    """Buses of a store after a batch of edits; only the blocks of their ids are written."""
    return _edited_catalog(t).rows("buses")


@_query("w5_stored_routes")
def _(t):
    return _edited_catalog(t).rows("routes")


@_query("w5_stored_assignments")
def _(t):
    return _edited_catalog(t).rows("bus_route")


@_query("w7_stored_users")
def _(t):
    return _edited_catalog(t).rows("users")


# ---- audits -------------------------------------------------------------


@_query("q1_double_sold")
def _(t):
    return audits.double_sold_seats(t)


@_query("q2_capacity")
def _(t):
    return audits.capacity_mismatch(t)


@_query("q3_fare")
def _(t):
    return audits.fare_mismatch(t)


@_query("q4_payments")
def _(t):
    return audits.payment_findings(t)


@_query("q5_unassigned_bus")
def _(t):
    return audits.unassigned_bus(t)


# ---- streams ------------------------------------------------------------


def change_stream(t: DerivedTables) -> DataFrame:
    """The change log as it arrives: a payment names its user, or nobody where the owner pays."""
    events = live.file_stream(t.spark, t.sf_dir, RAW["events"], "events.parquet")
    named = F.when(F.col("change_id") % 4 == 0, F.col("user_id"))
    return t.changes_from(events, t.n_orders).withColumn("user_id", named)


@_query("st1_status")
def _(t):
    claims = live.run_available(change_stream(t), live.STATUS_VIEW, "st1")
    return live.settled_status(claims, t.bookings)


@_query("st2_payment_totals")
def _(t):
    pays = change_stream(t).filter(F.col("kind") == "pay")
    claims = live.run_available(pays, live.PAYMENT_VIEW, "st2")
    return live.settled_totals(claims, t.bookings)


@_query("st3_occupancy")
def _(t):
    """Booked and free seats while the change log arrives in several micro-batches."""
    arriving = work_folder(t.spark, "arriving")
    t.change_log.repartition(3, "change_id").write.parquet(arriving)
    store = _new_store(t)
    stream = live.file_stream(t.spark, arriving, t.change_log.schema, files_per_batch=1)
    store.follow(stream, work_folder(t.spark, "st3-checkpoint"), availableNow=True).awaitTermination()
    return seats.trip_occupancy(t, seats.booked_trips(store.bookings()), held=store.held_seats())


def _signup_desk(t) -> signups.SignupDesk:
    """A desk that took the sign-ups in the order of arrival, in several micro-batches."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _DESKS:
        arriving, seen = work_folder(t.spark, "sign-ups"), work_folder(t.spark, "desk-checkpoint")
        regs = t.registrations
        desk = signups.SignupDesk.create(t.spark, work_folder(t.spark, "desk"), t.users)
        days = [r[0] for r in regs.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
        # Files by time; those of one arrival are a micro-batch, taken before the next arrive.
        for low, high in zip(days[:: len(days) // 3 + 1], [*days[len(days) // 3 + 1 :: len(days) // 3 + 1], None]):
            some = regs.filter(F.to_date("ts") >= F.lit(low))
            some = some if high is None else some.filter(F.to_date("ts") < F.lit(high))
            some.write.mode("append").parquet(arriving)
            stream = live.file_stream(t.spark, arriving, regs.schema, files_per_batch=2**31 - 1)
            desk.follow(stream, seen, availableNow=True).awaitTermination()
        _DESKS[key] = desk
    return _DESKS[key]


_DESKS: dict[tuple[str, str], signups.SignupDesk] = {}


@_query("st4_users")
def _(t):
    """Users after a stream of sign-ups."""
    return _signup_desk(t).users()


@_query("st4_rejects")
def _(t):
    return _signup_desk(t).rejects().select("reg_id", F.array_join("reasons", "; ").alias("reasons"))
