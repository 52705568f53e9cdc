"""Stored users, buses and routes that batches of edits change in place of a rewrite.

Rows lie by blocks of ids, the assignments of buses by the block of their route. A batch names
rows by id, so it reads and writes the blocks of its ids alone; the others are taken over by
name. What an edit does to the rows it reads is what :mod:`fareline.operators.changes` does
to whole tables. Every batch is one version (see ``fareline.sources.versions``); a batch
number that a version holds already is passed over.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fareline.operators import changes
from fareline.session import stored
from fareline.sources.schemas import TABLES
from fareline.sources.versions import Version, VersionedTables, partition_name

#: The blocks a table has at most when a store is made, unless a size of blocks is asked for.
BLOCKS = 64
#: The id that puts a row into its block.
KEYS = {"users": "user_id", "buses": "bus_id", "routes": "route_id", "bus_route": "route_id"}
SCHEMAS = {name: StructType([*TABLES[name].fields, StructField("block", LongType())]) for name in KEYS}


class Edited(NamedTuple):
    """The version a batch led to, and its refused edits; none for a batch that was there already."""

    version: Version
    rejects: DataFrame | None


class CatalogStore:
    def __init__(self, spark: SparkSession, folder: str, block_bits: int) -> None:
        """``block_bits``: rows of a block have the same id up to this many bits."""
        self.block_bits = block_bits
        self.tables = VersionedTables(spark, folder, SCHEMAS, dict.fromkeys(KEYS, "block"), KEYS)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, t, block_bits: int | None = None) -> CatalogStore:
        """A store of the tables of ``t``, in blocks that grow with the ids unless their bits are given.

        So the number of files of a table and of the names in a version stays the same at any size.
        """
        if block_bits is None:
            widest = [getattr(t, name).agg(F.max(F.abs(key))).first()[0] or 0 for name, key in KEYS.items()]
            block_bits = (max(widest) // BLOCKS).bit_length()
        store = cls(spark, folder, block_bits)
        written = [store.tables.write(name, store._placed(name, getattr(t, name))) for name in KEYS]
        store.tables.publish(store.tables.open(), written, block_bits=block_bits)
        return store

    def _placed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.shiftright(KEYS[table], self.block_bits))

    def _blocks(self, edits: DataFrame, key: str) -> list[str]:
        """The blocks of the edited rows, by name."""
        ids = edits.filter(F.col(key).isNotNull()).select(F.shiftright(key, self.block_bits)).distinct()
        return [partition_name("block", r[0]) for r in ids.collect()]

    def _of(self, version: Version, table: str, blocks: list[str]) -> DataFrame:
        return self.tables.read(version, table, blocks).drop("block")

    def _edit(self, edits: DataFrame, table: str, batch: int | None, change) -> Edited:
        """``change`` gives, of the version and the touched blocks, new rows by table, and the rejects."""
        version = self.tables.open()
        if batch is not None and batch <= version.notes.get("batch", -1):
            return Edited(version, None)
        edits = stored(edits, "edits")
        blocks = self._blocks(edits, KEYS[table])
        new, rejects = change(version, blocks, edits)
        written = [self.tables.write(name, self._placed(name, rows), blocks) for name, rows in new.items()] if blocks else []
        return Edited(self.tables.publish(version, written, **({} if batch is None else {"batch": batch})), rejects)

    def edit_buses(self, edits: DataFrame, batch: int | None = None) -> Edited:
        """See :func:`fareline.operators.changes.edit_buses`."""

        def change(version: Version, blocks: list[str], edits: DataFrame):
            out = changes.edit_buses(self._of(version, "buses", blocks), edits)
            return {"buses": out.buses}, out.rejects

        return self._edit(edits, "buses", batch, change)

    def edit_routes(self, edits: DataFrame, batch: int | None = None) -> Edited:
        """See :func:`fareline.operators.changes.edit_routes`; routes and assignments change together."""

        def change(version: Version, blocks: list[str], edits: DataFrame):
            out = changes.edit_routes(self._of(version, "routes", blocks), self._of(version, "bus_route", blocks), edits)
            return {"routes": out.routes, "bus_route": out.bus_route}, out.rejects

        return self._edit(edits, "routes", batch, change)

    def set_user_active(self, switches: DataFrame, batch: int | None = None) -> Edited:
        """See :func:`fareline.operators.changes.set_user_active`."""

        def change(version: Version, blocks: list[str], edits: DataFrame):
            return {"users": changes.set_user_active(self._of(version, "users", blocks), edits)}, None

        return self._edit(switches, "users", batch, change)

    def rows(self, table: str, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), table).drop("block")
