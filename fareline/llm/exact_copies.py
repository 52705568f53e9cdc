"""Exact copies found with two passes over a Bloom filter.

The first pass marks the slots of every text hash and notes which slots were hit by two
rows or more. The second pass asks for each row whether all its slots were: only such a
row can have a copy, so only these rows are shuffled and compared by their whole SHA-256;
the others pass straight through.

The slot space is cut into segments of fixed size by hash; a segment holds the rows of a
hash range, so their number grows with the table and their size does not. The driver hands
out ``SEGMENTS_AT_ONCE`` segments at a time and takes them back before the next: what is
broadcast never exceeds ``SEGMENTS_AT_ONCE * SEGMENT_SLOTS / 8`` bytes. More rows mean more
turns, each over its own partition of the rows, which were written by turn when they were
hashed. Every turn works alike, whether there is one or a thousand.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest
``doc_id`` of a group stays (null ids are smallest); rows that repeat id and text count in
``group_size``, and :func:`drop_copies` leaves one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op6_exact_copies"
ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
         AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

SEGMENT_SLOTS = 1 << 20
ROWS_PER_SEGMENT = 1 << 17
SEGMENTS_AT_ONCE = 256
PROBES = 3
_KEYS = "doc_id {}, text_sha256 binary, segment int, turn int"


def _digests(texts: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(t.lower()).digest() for t in texts]  # bytes.lower() changes A-Z alone


def _segments(digests: list[bytes], segments: int) -> np.ndarray:
    high = np.array([int.from_bytes(d[:4], "big") for d in digests], dtype=np.int64)
    return high * segments >> 32


def _hashed(docs: DataFrame, segments: int) -> DataFrame:
    """Id, SHA-256 of the normalised text, segment and turn of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.slices(batch, "text"):
                digests = _digests(tables.texts(part, "text"))
                segment = _segments(digests, segments)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(digests, pa.binary()),
                        pa.array(segment, pa.int32()),
                        pa.array(segment // SEGMENTS_AT_ONCE, pa.int32()),
                    ],
                    ["doc_id", "text_sha256", "segment", "turn"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _KEYS.format(id_type))


def _slots(digests: list[bytes]) -> np.ndarray:
    """The slots of each hash inside its segment, one row per hash, all different."""
    words = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, 8)[:, 1 : 1 + PROBES].astype(np.int64)
    third = SEGMENT_SLOTS // PROBES
    return words % third + np.arange(PROBES) * third


def _marks(keys: DataFrame) -> DataFrame:
    """Per batch and segment the slots that were hit once, and those hit more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(1).to_pylist()
            segment = batch.column(0).to_numpy(zero_copy_only=False)
            slots = segment[:, None].astype(np.int64) * SEGMENT_SLOTS + _slots(digests)
            found, hits = np.unique(slots, return_counts=True)
            cuts = np.flatnonzero(np.diff(found // SEGMENT_SLOTS)) + 1
            parts = list(zip(np.split(found, cuts), np.split(hits, cuts), strict=True)) if len(found) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(f[0] // SEGMENT_SLOTS) for f, _ in parts], pa.int32()),
                    pa.array([(f[h == 1] % SEGMENT_SLOTS).astype("<i4").tobytes() for f, h in parts], pa.binary()),
                    pa.array([(f[h > 1] % SEGMENT_SLOTS).astype("<i4").tobytes() for f, h in parts], pa.binary()),
                ],
                ["segment", "once", "more"],
            )

    return keys.select("segment", "text_sha256").mapInArrow(run, "segment int, once binary, more binary")


def _filters(marks: DataFrame) -> DataFrame:
    """One bit per slot of a segment: was it hit by two rows or more?

    A segment gets its rows' slots, ``ROWS_PER_SEGMENT`` on average and far fewer of a
    text that repeats, as each batch sends a slot once.
    """

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(SEGMENT_SLOTS, dtype=bool)
        twice = np.zeros(SEGMENT_SLOTS, dtype=bool)
        for once, more in zip(rows["once"], rows["more"], strict=True):
            slots, again = np.frombuffer(once, "<i4"), np.frombuffer(more, "<i4")
            twice[slots[seen[slots]]] = True
            twice[again] = True
            seen[slots] = True
            seen[again] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(twice).tobytes()]})

    return marks.groupBy("segment").applyInPandas(merge, "segment int, bits binary")


def _probe(bits: dict[int, bytes], digests: list[bytes], segment: np.ndarray) -> np.ndarray:
    slots = _slots(digests)
    maybe = np.zeros(len(digests), dtype=bool)
    for s in np.unique(segment):
        mine = segment == s
        at = slots[mine]
        marked = np.frombuffer(bits[s], dtype=np.uint8)
        maybe[mine] = (marked[at >> 3] >> (7 - (at & 7)) & 1).all(axis=1)
    return maybe


def _turns(docs: DataFrame) -> tuple[int, int]:
    """How many segments the rows need, and in how many turns these are handed out."""
    segments = max(1, -(-docs.count() // ROWS_PER_SEGMENT))
    return segments, -(-segments // SEGMENTS_AT_ONCE)


@contextmanager
def _filter_of(keys: DataFrame) -> Iterator[Callable[..., Column]]:
    """A column that asks the filter of the rows of one turn; the filter goes at the end.

    ``keys`` holds ``segment`` and ``text_sha256``. What uses the column is to be written
    before the end.
    """
    bits = {r["segment"]: r["bits"] for r in _filters(_marks(keys)).toLocalIterator()}
    handed = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(sha: pa.Array, segment: pa.Array) -> pa.Array:
        return pa.array(_probe(handed.value, sha.to_pylist(), segment.to_numpy(zero_copy_only=False)))

    try:
        yield maybe
    finally:
        handed.destroy()


def flagged(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256, maybe)``: the answer of the filter for each row."""
    segments, turns = _turns(docs)
    keys = tables.kept(_hashed(docs, segments), "copies-hash", "turn")
    out = []
    for turn in range(turns):
        part = keys.filter(F.col("turn") == turn).drop("turn")
        with _filter_of(part) as maybe:
            told = part.select("doc_id", "text_sha256", maybe("text_sha256", "segment").alias("maybe"))
            out.append(tables.kept(told, "copies-flag"))
    return reduce(DataFrame.unionByName, out)


def groups(rows: DataFrame) -> DataFrame:
    """Of the rows that may have copies: what stays of each text, and how many there are."""
    return rows.filter("maybe").groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def find_copies(docs: DataFrame) -> DataFrame:
    """One row per document with the row that stays in its place."""
    rows = flagged(docs)
    found = tables.kept(groups(rows), "copies-groups")
    own = F.col("doc_id")
    alone = rows.filter("not maybe").select("doc_id", own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = rows.filter("maybe").join(found, "text_sha256").select(*alone.columns)
    return alone.unionByName(shared).select(
        "doc_id",
        "keep_id",
        "group_size",
        own.eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def by_turn(docs: DataFrame) -> tuple[DataFrame, int, list[str]]:
    """The documents beside their hash, written by turn; how many turns; the names of what was added."""
    segments, turns = _turns(docs)
    look, sha, segment, turn = (tables.unused(docs, n) for n in ("_look", "_sha", "_segment", "_turn"))

    @F.arrow_udf("struct<sha:binary,segment:int>")
    def looked(column: pa.Array) -> pa.Array:
        digests, start = [], 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        while start < len(lengths):  # texts are taken out of the batch a few megabytes at a time
            stop, size = start + 1, lengths[start]
            while stop < len(lengths) and size + lengths[stop] <= tables.SLICE_BYTES:
                size += lengths[stop]
                stop += 1
            digests += _digests([t or b"" for t in column.slice(start, stop - start).cast(pa.large_binary()).to_pylist()])
            start = stop
        found = pa.array(_segments(digests, segments), pa.int32())
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), found], ["sha", "segment"])

    hashed = docs.withColumn(look, looked("text")).select(
        *docs.columns,
        F.col(look)["sha"].alias(sha),
        F.col(look)["segment"].alias(segment),
        F.floor(F.col(look)["segment"] / SEGMENTS_AT_ONCE).cast("int").alias(turn),
    )
    return tables.kept(hashed, "copies-docs", turn), turns, [sha, segment, turn]


def one_turn(part: DataFrame, maybe: Callable[..., Column], sha: str, segment: str) -> DataFrame:
    """What stays of the rows of a turn: those that cannot have a copy pass straight through."""
    flag, best_sha, best_id = (tables.unused(part, n) for n in ("_flag", "_best_sha", "_best_id"))
    seen = part.withColumn(flag, maybe(sha, segment))
    suspects = seen.filter(flag)
    winners = suspects.groupBy(F.col(sha).alias(best_sha)).agg(F.max("doc_id").alias(best_id))
    stay = suspects.join(
        tables.kept(winners, "copies-groups"),
        (F.col(sha) == F.col(best_sha)) & F.col("doc_id").eqNullSafe(F.col(best_id)),
        "left_semi",
    ).dropDuplicates(["doc_id", sha])
    return seen.filter(~F.col(flag)).unionByName(stay).drop(flag, sha, segment)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stored, turns, (sha, segment, turn) = by_turn(docs)
    out = []
    for k in range(turns):
        part = stored.filter(F.col(turn) == k).drop(turn)
        with _filter_of(part.select(F.col(segment).alias("segment"), F.col(sha).alias("text_sha256"))) as maybe:
            out.append(tables.kept(one_turn(part, maybe, sha, segment), "copies-left"))
    return reduce(DataFrame.unionByName, out).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(tables.table(spark, sf_dir, "documents"))
