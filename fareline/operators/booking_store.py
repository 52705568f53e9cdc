"""Stored bookings that batches of requests change in place of a rewrite.

Bookings lie by journey day. A batch names bookings by id; an index by blocks of ids says on
which days they are, and only these days are read and written anew. What reports count is
stored beside them as totals and kept up to date by signed differences between the old and the
new rows of a batch: bookings, status and money per user, bookings per route, payments, and how
many live bookings hold each seat. Reading a report sums the parts of its totals; no report
and no batch reads the bookings of other days.

All tables of a commit appear together, as one version (see ``fareline.sources.versions``). A
stream commits micro-batches with their number, and a number that a version holds already is
passed over. A booking keeps the time of its last change, so that an older change that comes
late does nothing, however the changes are split into batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DecimalType, LongType, StructField, StructType, TimestampNTZType

from fareline.functions import fixed_values as V
from fareline.functions.text import same_text, sanitize
from fareline.operators import changes
from fareline.session import stored
from fareline.sources.schemas import TABLES
from fareline.sources.versions import Version, VersionedTables, Written, partition_name

#: Bookings of a block have the same id up to this many bits.
BLOCK_BITS = 20
#: Parts of totals are added up, and small files put together, beyond this many commits.
PARTS = 20

LONG, MONEY = LongType(), DecimalType(18, 2)


def _plus(schema: StructType, **columns) -> StructType:
    return StructType([*schema.fields, *(StructField(n, t) for n, t in columns.items())])


SCHEMAS = {
    "bookings": _plus(TABLES["bookings"], is_listed=LONG, changed_ts=TimestampNTZType(), changed_id=LONG),
    "days": StructType([StructField("booking_id", LONG), TABLES["bookings"]["journey_date"], StructField("block", LONG)]),
    "booking_seat": _plus(TABLES["booking_seat"], block=LONG),
    "payments": _plus(TABLES["payments"], block=LONG),
    "holds": _plus(StructType(), route_id=LONG, seat_id=LONG, n=LONG, journey_date=TABLES["bookings"]["journey_date"].dataType),
    "user_totals": _plus(StructType(), user_id=LONG, list_rows=LONG, total_bookings=LONG, confirmed=LONG, pending=LONG, total_spent=MONEY),
    "route_totals": _plus(StructType(), route_id=LONG, booking_count=LONG),
    "payment_totals": _plus(StructType(), n_payments=LONG, revenue=MONEY),
}
PARTITIONED = {"bookings": "journey_date", "days": "block", "booking_seat": "block", "payments": "block", "holds": "journey_date"}
SORTED = {"bookings": "created_at"}
#: What a batch of changes reads of the bookings it names.
KNOWN = ["booking_id", "user_id", "route_id", "journey_date", "status", "total_amount", "is_listed", "changed_ts", "changed_id"]
#: What the parts of a table of totals are added up by.
KEYS = {"holds": ["journey_date", "route_id", "seat_id"], "user_totals": ["user_id"], "route_totals": ["route_id"], "payment_totals": []}


class Applied(NamedTuple):
    """The version a batch led to, and its refused requests; none for a batch that was there already."""

    version: Version
    rejects: DataFrame | None


def _block() -> Column:
    return F.shiftright("booking_id", BLOCK_BITS).alias("block")


def _is(status: str, column: str = "status") -> Column:
    return F.coalesce(same_text(F.col(column), status), F.lit(False)).cast("long")


def _is_live(column: str = "status") -> Column:
    """1 where a booking holds its seats: not cancelled, and a status at all."""
    return F.coalesce(~same_text(F.col(column), V.STATUS_CANCELLED), F.lit(False)).cast("long")


def _added(parts: DataFrame, table: str) -> DataFrame:
    """The parts of a table of totals added up."""
    schema, keys = SCHEMAS[table], KEYS[table]
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in keys]
    return (parts.groupBy(*keys) if keys else parts.groupBy()).agg(*sums)


class BookingStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.tables = VersionedTables(spark, folder, SCHEMAS, PARTITIONED, SORTED)

    # ---- the first version ---------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, folder: str, t) -> BookingStore:
        """A store of the bookings, seats and payments of ``t``; the only time that all are read."""
        store = cls(spark, folder)
        bookings = cls._listed(t.bookings, t).withColumns(
            {"changed_ts": F.lit(None).cast("timestamp_ntz"), "changed_id": F.lit(None).cast("long")}
        )
        newest, n_days = store._newest(t.bookings, {})
        last = t.bookings.agg(F.min("booking_id"), F.max("booking_id")).first()
        n_blocks = 0 if last[0] is None else (last[1] >> BLOCK_BITS) - (last[0] >> BLOCK_BITS) + 1
        # All else is made from the files of these two, so that nothing is joined or derived again for it.
        first = [
            store._write("bookings", bookings, values=n_days),
            store._write("payments", t.payments.select("*", _block()), values=n_blocks),
        ]
        bookings, payments = (store.tables.read_written(w) for w in first)
        user_rows = cls._user_rows(bookings).unionByName(cls._paid_again(bookings, payments))
        written = [
            *first,
            *store._new_rows(bookings, t.booking_seat, n_blocks),
            store._write("holds", cls._holds(bookings, t.booking_seat), values=n_days),
            store._write("user_totals", _added(user_rows, "user_totals")),
            store._write("payment_totals", cls._payment_totals(payments)),
        ]
        highest = {
            "booking_id": last[1],
            "payment_id": payments.agg(F.max("payment_id")).first()[0],
        }
        store.tables.publish(store.tables.open(), written, highest=highest, newest=newest)
        return store

    @staticmethod
    def _newest(bookings: DataFrame, before: dict[str, str]) -> tuple[dict[str, str], int]:
        """The latest creation day of the bookings of each journey day, an entry per day, and the days of these."""
        out = dict(before)
        days = bookings.groupBy("journey_date").agg(F.max("created_at")).collect()
        for day, at in days:
            name = partition_name("journey_date", day)
            if at is not None:
                out[name] = max(out.get(name, ""), str(at))
        return out, len(days)

    @staticmethod
    def _listed(bookings: DataFrame, t) -> DataFrame:
        """With a flag for bookings that lists show: those whose bus and route are there."""
        return (
            bookings.join(t.buses.select("bus_id", F.lit(1).alias("has_bus")), "bus_id", "left")
            .join(t.routes.select("route_id", F.lit(1).alias("has_route")), "route_id", "left")
            .withColumn("is_listed", (F.col("has_bus").isNotNull() & F.col("has_route").isNotNull()).cast("long"))
            .drop("has_bus", "has_route")
        )

    @staticmethod
    def _user_rows(bookings: DataFrame) -> DataFrame:
        """What each booking adds to its user's totals; unless it is paid twice, it is one row of a list."""
        return bookings.select(
            "user_id",
            F.col("is_listed").alias("list_rows"),
            F.lit(1).cast("long").alias("total_bookings"),
            _is(V.STATUS_CONFIRMED).alias("confirmed"),
            _is(V.STATUS_PENDING).alias("pending"),
            F.coalesce("total_amount", F.lit(0)).cast(MONEY).alias("total_spent"),
        )

    @staticmethod
    def _only_list_rows(rows: DataFrame) -> DataFrame:
        """``user_id`` and ``list_rows`` as parts of totals that add nothing else."""
        zero = F.lit(0).cast("long")
        return rows.filter(F.col("list_rows") != 0).select(
            "user_id", "list_rows", *[zero.alias(c) for c in ("total_bookings", "confirmed", "pending")], F.lit(0).cast(MONEY).alias("total_spent")
        )

    @classmethod
    def _paid_again(cls, bookings: DataFrame, payments: DataFrame) -> DataFrame:
        """The list rows that payments after a booking's first add."""
        again = payments.groupBy("booking_id").agg((F.count(F.lit(1)) - 1).alias("more")).filter(F.col("more") > 0)
        rows = bookings.join(stored(again, "paid-again"), "booking_id")
        return cls._only_list_rows(rows.select("user_id", (F.col("more") * F.col("is_listed")).alias("list_rows")))

    @staticmethod
    def _holds(bookings: DataFrame, booking_seat: DataFrame) -> DataFrame:
        """How many live ones of the bookings hold each seat."""
        live = bookings.filter(_is_live() == 1).select("booking_id", "route_id", "journey_date")
        return booking_seat.join(live, "booking_id").groupBy(*KEYS["holds"]).agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def _payment_totals(payments: DataFrame) -> DataFrame:
        return payments.agg(
            F.count(F.lit(1)).alias("n_payments"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("revenue")
        )

    def _write(
        self, table: str, rows: DataFrame, replaced: list[str] | None = None, values: int | None = None
    ) -> Written:
        return self.tables.write(table, rows, replaced, values)

    def _new_rows(self, bookings: DataFrame, booking_seat: DataFrame, n_blocks: int | None = None) -> list[Written]:
        """What follows from new bookings, which are stored, and their seats."""
        by_route = bookings.groupBy("route_id").agg(F.count(F.lit(1)).alias("booking_count"))
        return [
            self._write("days", bookings.select("booking_id", "journey_date", _block()), values=n_blocks),
            # A link may name a booking that is not there, and so any block.
            self._write("booking_seat", booking_seat.select("*", _block())),
            self._write("route_totals", by_route),
        ]

    # ---- batches -------------------------------------------------------------

    def _blocks(self, ids: DataFrame) -> list[str]:
        """The blocks of some bookings: one name per 2^20 ids at most."""
        return [partition_name("block", r[0]) for r in ids.select(_block()).distinct().collect()]

    def _days(self, version: Version, ids: DataFrame) -> list[str]:
        """The partitions of the days that some bookings are on: no more than there are days."""
        index = self.tables.read(version, "days", self._blocks(ids))
        found = index.join(ids.select("booking_id").distinct(), "booking_id", "left_semi").select("journey_date").distinct()
        return [partition_name("journey_date", r[0]) for r in found.collect()]

    def _is_done(self, version: Version, batch: int | None) -> bool:
        return batch is not None and batch <= version.notes.get("batch", -1)

    def _publish(self, version: Version, written: Iterable[Written], batch: int | None, **notes) -> Version:
        if batch is not None:
            notes["batch"] = batch
        return self.fold(self.tables.publish(version, written, **notes))

    def apply_status(self, log: DataFrame, batch: int | None = None) -> Applied:
        """Give each booking its last requested status; see :func:`fareline.operators.changes.apply_status`."""
        version = self.tables.open()
        if self._is_done(version, batch):
            return Applied(version, None)
        asked = stored(log.select("booking_id", "ts", "change_id", "new_status"), "changes")
        return Applied(self._publish(version, self._changed(version, asked, self._named(version, asked)), batch), None)

    def apply_log(self, log: DataFrame, batch: int | None = None) -> Applied:
        """Status changes and payments of one log, as :func:`fareline.operators.changes.apply_changes`.

        A payment that names no user counts as the owner's.
        """
        version = self.tables.open()
        if self._is_done(version, batch):
            return Applied(version, None)
        named = ["change_id", "ts", "booking_id", "kind", "new_status", "payment_method", "user_id"]
        log = stored(log.select(*named), "log")
        old = self._named(version, log)
        owners = old.select("booking_id", F.col("user_id").alias("owner_id"), "total_amount")
        owned = log.join(owners, "booking_id").withColumn("user_id", F.coalesce("user_id", "owner_id"))
        owned = stored(owned, "owned-log")
        effective = changes.effective_entries(owned)
        accepted = owned.filter((F.col("kind") == "pay") & (F.col("user_id") == F.col("owner_id")))
        written = self._changed(version, effective, old)
        highest = dict(version.notes["highest"])
        if not accepted.isEmpty():
            first = -1 if highest["payment_id"] is None else highest["payment_id"]
            posted = changes.posted_payments(accepted, F.lit(first + 1))
            blocks = self._blocks(accepted)
            written += [
                self._write("payments", posted.select("*", _block())),
                self._write("payment_totals", self._payment_totals(posted)),
                self._write("user_totals", self._more_rows(version, accepted, old, blocks)),
            ]
            highest["payment_id"] = posted.agg(F.max("payment_id")).first()[0]
        rejects = changes.refused_payments(log.filter(F.col("kind") == "pay"), accepted)
        return Applied(self._publish(version, written, batch, highest=highest), rejects)

    def _named(self, version: Version, log: DataFrame) -> DataFrame:
        """What a batch has to know of the bookings it names, stored: the days are read and shuffled once."""
        old = self.tables.read(version, "bookings", self._days(version, log)).select(*KNOWN)
        return stored(old.join(log.select("booking_id").distinct(), "booking_id", "left_semi"), "named-bookings")

    def _changed(self, version: Version, asked: DataFrame, old: DataFrame) -> list[Written]:
        """The files made by the bookings that get another status or time of change; ``old`` as :meth:`_named`."""
        wanted = asked.groupBy("booking_id").agg(
            F.max_by(F.struct(sanitize(F.col("new_status")).alias("status"), "ts", "change_id"), changes.change_order()).alias("to")
        )
        newer = F.col("changed_id").isNull() | (
            F.struct("to.ts", "to.change_id") > F.struct(F.col("changed_ts").alias("ts"), F.col("changed_id").alias("change_id"))
        )
        changed = stored(
            old.join(wanted, "booking_id").filter(newer).select(
                "booking_id",
                "user_id",
                "route_id",
                "journey_date",
                "status",
                F.col("to.status").alias("new_status"),
                F.col("to.ts").alias("new_ts"),
                F.col("to.change_id").alias("new_id"),
            ),
            "changed-bookings",
        )
        touched = [partition_name("journey_date", r[0]) for r in changed.select("journey_date").distinct().collect()]
        if not touched:
            return []
        to = changed.select("booking_id", "new_status", "new_ts", "new_id")
        edited = F.col("new_id").isNotNull()
        new = self.tables.read(version, "bookings", touched).join(to, "booking_id", "left").withColumns(
            {
                name: F.when(edited, F.col(value)).otherwise(F.col(name))
                for name, value in (("status", "new_status"), ("changed_ts", "new_ts"), ("changed_id", "new_id"))
            }
        )
        zero = F.lit(0).cast("long")
        moved = changed.groupBy("user_id").agg(
            F.sum(zero).alias("list_rows"),
            F.sum(zero).alias("total_bookings"),
            F.sum(_is(V.STATUS_CONFIRMED, "new_status") - _is(V.STATUS_CONFIRMED)).alias("confirmed"),
            F.sum(_is(V.STATUS_PENDING, "new_status") - _is(V.STATUS_PENDING)).alias("pending"),
            F.lit(0).cast(MONEY).alias("total_spent"),
        )
        signs = changed.withColumn("sign", _is_live("new_status") - _is_live()).filter(F.col("sign") != 0)
        held = self.tables.read(version, "booking_seat", self._blocks(signs)).join(
            signs.select("booking_id", "route_id", "journey_date", "sign"), "booking_id"
        )
        return [
            self._write("bookings", new, touched, len(touched)),
            self._write("user_totals", moved.filter((F.col("confirmed") != 0) | (F.col("pending") != 0))),
            self._write("holds", held.groupBy(*KEYS["holds"]).agg(F.sum("sign").alias("n"))),
        ]

    def _more_rows(self, version: Version, accepted: DataFrame, old: DataFrame, blocks: list[str]) -> DataFrame:
        """The list rows that new payments add: a booking has one for each, and one without any."""
        new = accepted.groupBy("booking_id").agg(F.count(F.lit(1)).alias("more"))
        had = self.tables.read(version, "payments", blocks).join(new.select("booking_id"), "booking_id", "left_semi")
        had = had.groupBy("booking_id").agg(F.count(F.lit(1)).alias("had"))
        before = F.coalesce("had", F.lit(0))
        more = F.greatest(before + F.col("more"), F.lit(1)) - F.greatest(before, F.lit(1))
        rows = old.join(new, "booking_id").join(had, "booking_id", "left").groupBy("user_id").agg(
            F.sum(more * F.col("is_listed")).alias("list_rows")
        )
        return self._only_list_rows(rows)

    def add_bookings(
        self, t, requests: DataFrame, as_of: str | dt.date, refuse_clashes: bool = False, batch: int | None = None
    ) -> Applied:
        """Turn requests into bookings, see :func:`fareline.operators.changes.create_bookings`.

        ``t`` names the buses and routes. Their days get files beside those they have.
        """
        version = self.tables.open()
        if self._is_done(version, batch):
            return Applied(version, None)
        highest = dict(version.notes["highest"])
        first = -1 if highest["booking_id"] is None else highest["booking_id"]
        held = None
        if refuse_clashes:
            asked = [partition_name("journey_date", r[0]) for r in requests.select("journey_date").distinct().collect()]
            held = self.held_seats(version, asked)
        new = changes.added_bookings(t.routes, F.lit(first + 1), requests, as_of, held)
        rows = self._listed(new.bookings, t).withColumns(
            {"changed_ts": F.lit(None).cast("timestamp_ntz"), "changed_id": F.lit(None).cast("long")}
        )
        rows = stored(rows, "added-bookings")
        links = stored(new.booking_seat, "added-seats")
        if rows.isEmpty():
            return Applied(self._publish(version, [], batch), new.rejects)
        newest, n_days = self._newest(rows, version.notes["newest"])
        written = [
            self._write("bookings", rows, values=n_days),
            *self._new_rows(rows, links),
            self._write("holds", self._holds(rows, links)),
            self._write("user_totals", _added(self._user_rows(rows), "user_totals")),
        ]
        highest["booking_id"] = rows.agg(F.max("booking_id")).first()[0]
        return Applied(self._publish(version, written, batch, highest=highest, newest=newest), new.rejects)

    def follow(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a stream of status changes and payments, a commit per micro-batch."""

        def write(batch: DataFrame, number: int) -> None:
            self.apply_log(batch, number)

        return (
            log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )

    # ---- upkeep --------------------------------------------------------------

    def fold(self, version: Version, parts: int | None = None) -> Version:
        """Add up totals, and put files together, of partitions with more than ``parts`` commits."""
        parts = PARTS if parts is None else parts
        written = []
        for table in SCHEMAS:
            many = [p for p, commits in version.parts.get(table, {}).items() if len(commits) > parts]
            if many:
                rows = self.tables.read(version, table, many)
                if table in KEYS:
                    rows = _added(rows, table)
                if table == "holds":
                    rows = rows.filter(F.col("n") != 0)
                written.append(self._write(table, rows, many))
        return self.tables.publish(version, written) if written else version

    # ---- what it holds -------------------------------------------------------

    def bookings(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), "bookings").select(*TABLES["bookings"].names)

    def newest_bookings(self, n: int, whole=None, version: Version | None = None) -> DataFrame:
        """The newest ``n`` bookings, read from as few days as hold them.

        ``whole`` leaves out rows of a frame of bookings that are not to count. The day with the
        latest creation is read first, then others in turn, until ``n`` rows stand; what
        comes after the last of them is left unread, by days and by the statistics of files.
        """
        version = version or self.tables.open()
        names = TABLES["bookings"].names
        keep = whole or (lambda rows: rows)

        def rows(partitions: list[str]) -> DataFrame:
            return keep(self.tables.read(version, "bookings", partitions).select(*names))

        def top(found: DataFrame) -> DataFrame:
            return found.orderBy(F.col("created_at").desc(), F.col("booking_id").desc()).limit(n)

        newest = version.notes["newest"]
        order = sorted(newest, key=lambda p: (newest[p], p), reverse=True)
        taken = 1
        while True:
            found = top(rows(order[:taken])).select("created_at").collect()
            if len(found) == n or taken >= len(order):
                break
            taken *= 2
        least = found[-1][0] if len(found) == n else None
        if least is None:  # too few rows anywhere, or the last of them has no day of creation
            return top(rows(list(version.parts.get("bookings", {}))))
        later = [p for p in order if newest[p] >= str(least)]
        return top(rows(later).filter(F.col("created_at") >= F.lit(least)))

    def booking_seat(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), "booking_seat").drop("block")

    def payments(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), "payments").drop("block")

    def totals(self, table: str, version: Version | None = None) -> DataFrame:
        return self._sums(version or self.tables.open(), table)

    def held_seats(self, version: Version | None = None, partitions: Iterable[str] | None = None) -> DataFrame:
        """``(journey_date, route_id, seat_id, n)`` of the seats that live bookings hold."""
        return self._sums(version or self.tables.open(), "holds", partitions).filter(F.col("n") > 0)

    def _sums(self, version: Version, table: str, partitions: Iterable[str] | None = None) -> DataFrame:
        """A table of totals; a partition of one commit has a row per key already and is only read."""
        held = version.parts.get(table, {})
        chosen = list(held if partitions is None else partitions)
        single = [p for p in chosen if KEYS[table] and len(held.get(p, ())) == 1]
        parts = [p for p in chosen if p not in single]
        if not single:
            return _added(self.tables.read(version, table, parts), table)
        rows = self.tables.read(version, table, single)
        return rows.unionByName(_added(self.tables.read(version, table, parts), table)) if parts else rows
