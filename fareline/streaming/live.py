"""Live views kept by Structured Streaming: booking status and payment totals.

What a view keeps is what was asked for, per booking and asking user. Whether that user
owns the booking, and what the booking costs, is looked up when the view is read, so that
no micro-batch reads the bookings.

Both views merge: the newest request of two parts is the newer of their newest, counts add
up. So a micro-batch is aggregated by itself and written as a part of its own, without any
streaming state, and the parts are folded when the view is read. From time to time the parts
are merged into one, so their number stays bounded.

A view changes by versions (see ``fareline.sources.versions``): each names its parts and the
last micro-batch they hold, and appears in one rename. A repeated micro-batch is passed over, a
writer that dies leaves the version before, and a reader goes on with the version it opened:
the files of a version go only ``KEPT_VERSIONS`` versions later.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fareline.functions.fixed_values import STATUS_CONFIRMED
from fareline.operators.changes import change_order, payable
from fareline.session import work_folder
from fareline.sources.versions import Version, VersionedTables

CLAIM = ["booking_id", "kind", "payer"]
PAYMENT = ["booking_id", "user_id", "payment_method"]


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    files: str = "*.parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Parquet files of a folder as a stream, under a declared schema."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


# ---- booking status ---------------------------------------------------------


def status_claims(log: DataFrame) -> DataFrame:
    """The newest status each booking is asked to take.

    Payments are kept apart by paying user; NULL stands for the owner, whoever that is. A
    late entry never overrides a newer one, so no watermark is needed.
    """
    is_pay = F.col("kind") == "pay"
    asked = log.select(
        "booking_id",
        F.when(is_pay, "pay").otherwise("set_status").alias("kind"),
        F.when(is_pay, F.col("user_id")).alias("payer"),
        F.when(is_pay, STATUS_CONFIRMED).otherwise(F.col("new_status")).alias("status"),
        change_order().alias("at"),
    )
    return newest_claims(asked)


def newest_claims(claims: DataFrame) -> DataFrame:
    return claims.groupBy(*CLAIM).agg(
        F.max_by("status", "at").alias("status"), F.max("at").alias("at")
    )


def settled_status(claims: DataFrame, bookings: DataFrame) -> DataFrame:
    """The current status of every known booking in the view; strangers' payments do not count."""
    owners = bookings.select("booking_id", F.col("user_id").alias("owner_id"))
    valid = claims.join(owners, "booking_id").filter(
        (F.col("kind") != "pay") | (F.coalesce("payer", "owner_id") == F.col("owner_id"))
    )
    return valid.groupBy("booking_id").agg(
        F.max_by("status", "at").alias("status"), F.max("at.ts").alias("changed_at")
    )


# ---- payment totals ---------------------------------------------------------


def payment_claims(pays: DataFrame) -> DataFrame:
    """How often each user paid for each booking by each method; a NULL user is the owner."""
    return pays.groupBy(*PAYMENT).agg(F.count(F.lit(1)).alias("n"))


def added_claims(claims: DataFrame) -> DataFrame:
    return claims.groupBy(*PAYMENT).agg(F.sum("n").alias("n"))


def settled_totals(claims: DataFrame, bookings: DataFrame) -> DataFrame:
    """Payments by the owner of a booking and their sum, by method."""
    owners = bookings.select("booking_id", F.col("user_id").alias("owner_id"))
    named = claims.filter("user_id IS NULL").join(owners, "booking_id").select(
        "booking_id", F.col("owner_id").alias("user_id"), "payment_method", "n"
    )
    stated = claims.filter("user_id IS NOT NULL").select("booking_id", "user_id", "payment_method", "n")
    return payable(stated.unionByName(named), bookings).groupBy("payment_method").agg(
        F.sum("n").alias("n_payments"),
        F.sum(F.col("n") * F.col("total_amount")).cast("decimal(18,2)").alias("revenue"),
    )


# ---- views on disk ----------------------------------------------------------


class View(NamedTuple):
    """How a micro-batch becomes a part of the view, and how parts are merged."""

    part: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


STATUS_VIEW = View(status_claims, newest_claims)
PAYMENT_VIEW = View(payment_claims, added_claims)

#: The parts of a view are merged after this many micro-batches.
MERGE_EVERY = 20
#: The newest versions that keep their files.
KEPT_VERSIONS = 50


def view_tables(spark: SparkSession, folder: str, schema: StructType) -> VersionedTables:
    """The stored parts of a view; ``schema`` is that of a part."""
    return VersionedTables(spark, folder, {"parts": schema})


def start_view(
    stream: DataFrame,
    view: View,
    folder: str,
    merge_every: int = MERGE_EVERY,
    kept_versions: int = KEPT_VERSIONS,
    **trigger,
) -> StreamingQuery:
    """Keep a view of a stream up to date below ``folder``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part = view.part(batch)
        tables = view_tables(batch.sparkSession, folder, part.schema)
        version = tables.open()
        if batch_id <= version.notes.get("batch", -1):
            return
        version = tables.publish(version, [tables.write("parts", part)], batch=batch_id)
        if tables.parts_of(version, "parts") >= merge_every:
            merge_parts(tables, view, kept_versions)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def merge_parts(tables: VersionedTables, view: View, kept_versions: int = KEPT_VERSIONS) -> Version:
    """Merge all parts into one, as the next version, and delete what only old versions name.

    Runs between two micro-batches of the view's own stream, or while that is stopped.
    """
    version = tables.open()
    if tables.parts_of(version, "parts") > 1:
        merged = view.merge(tables.read(version, "parts"))
        version = tables.publish(version, [tables.write("parts", merged, [""])])
    tables.forget(kept_versions)
    return version


def read_view(spark: SparkSession, view: View, folder: str, schema: StructType) -> DataFrame:
    """The present rows of a view; ``schema`` is that of a part. Later versions do not disturb a reader."""
    tables = view_tables(spark, folder, schema)
    return view.merge(tables.read(tables.open(), "parts"))


def run_available(stream: DataFrame, view: View, purpose: str) -> DataFrame:
    """Run a streaming view once over what has arrived and return its rows."""
    spark = stream.sparkSession
    folder = work_folder(spark, purpose)
    start_view(stream, view, folder, availableNow=True).awaitTermination()
    like_stream = spark.createDataFrame([], stream.schema)
    return read_view(spark, view, folder, view.part(like_stream).schema)
