"""Reading and writing the stored tables as parquet snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.sources.schemas import BUCKETING, PARTITIONING, TABLES


@dataclass(frozen=True)
class Tables:
    """The eight tables every operator works on."""

    users: DataFrame
    buses: DataFrame
    seats: DataFrame
    routes: DataFrame
    bus_route: DataFrame
    bookings: DataFrame
    booking_seat: DataFrame
    payments: DataFrame


def load_tables(spark: SparkSession, folder: str) -> Tables:
    """Open ``folder/<table>`` for each table under its declared schema."""
    return Tables(
        **{
            name: spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)
            for name, schema in TABLES.items()
        }
    )


#: Rows of at most so many partition values are written by the tasks that have them.
FEW_VALUES = 16


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), values: int | None = None
) -> None:
    """Write one snapshot to a new path.

    For a partitioned table the rebalance hint brings the rows of a partition value
    together and lets adaptive execution cut a value that holds too many of them. That
    shuffles all rows, so it is left out where ``values``, the number of partition values, is
    known to be small: then each task writes a file for each.
    ``sort_by``: the order inside a file, so that the statistics of its row groups tell.
    """
    straight = values is not None and values <= FEW_VALUES
    rows = df.hint("rebalance", *partition_by) if partition_by and not straight else df
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    rows.write.mode("errorifexists").partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def write_tables(tables, folder: str) -> None:
    """Write all eight tables in the layout :func:`load_tables` reads."""
    for name, schema in TABLES.items():
        df = getattr(tables, name).select(*schema.names)
        write_table(df, f"{folder}/{name}", PARTITIONING.get(name, []))


def save_tables(tables, database: str, buckets: int) -> None:
    """Write all eight tables to a catalog database, for :func:`open_tables`.

    The tables keyed by booking are cut into the same buckets, so lists, details,
    seat maps and payment reports join them without a shuffle. A bucket is read by
    one task and cannot be split: keep plain snapshots where single bookings hold a
    large share of the seats or payments, and where dates should prune files.
    """
    for name, schema in TABLES.items():
        df = getattr(tables, name).select(*schema.names)
        key = BUCKETING.get(name)
        if key is None:
            writer = df.write
        else:
            writer = df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key)
        # Not by day as well: every bucket would hold a file of every day.
        if key is None and name in PARTITIONING:
            writer = writer.partitionBy(*PARTITIONING[name])
        writer.format("parquet").mode("errorifexists").saveAsTable(f"{database}.{name}")


def open_tables(spark: SparkSession, database: str) -> Tables:
    """The tables of a catalog database written by :func:`save_tables`."""
    return Tables(
        **{
            name: spark.table(f"{database}.{name}").select(*schema.names)
            for name, schema in TABLES.items()
        }
    )
