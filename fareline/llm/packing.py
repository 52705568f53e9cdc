"""Packing of token ids: optimal length buckets and batches of a token budget.

Texts become ids of a byte-level vocabulary. A text longer than ``MAX_LENGTH`` tokens is cut into pieces of that length, so the global
histogram of piece lengths has at most ``MAX_LENGTH`` entries whatever the table holds. A
dynamic program over it chooses the bucket boundaries for which padding every piece to the
boundary of its bucket adds the fewest tokens. Inside a bucket, groups of about
``GROUP_ROWS`` pieces, dealt by hash, are cut into batches of as many pieces as the token
budget holds at the bucket's boundary; only the last batch of a group may be smaller.

Ids are stored and shuffled as bytes, two an id where the vocabulary is small enough for it, and
become numbers again in the result.

Every document is packed whole: its pieces' ids in order decode to its text. A null or empty
text has no token and gives one piece of length 0 in the first bucket. Rows that repeat, null
ids included, are packed one by one and dealt to different groups. Strings of special tokens
in a text are ordinary text. An empty table gives no row. :func:`batches` gives the padded
batches themselves; :func:`pieces` does for lengths alone, from any column of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.llm import tables
from fareline.llm.swap_packing import ByteVocabulary, token_ids

NAME = "op9_packing"
ORACLE = None  # boundaries come from a dynamic program: checked against every choice on small input

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PAD_ID = 0
MAX_LENGTH = 2048
BUCKETS = 12
TOKEN_BUDGET = 65_536
GROUP_ROWS = 2048
#: Rows whose ids a task turns into numbers at a time.
SENT_ROWS = 1024


def word_count(text: str = "text") -> Column:
    """Words between spaces and control characters 9 to 13, without an array of them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(docs: DataFrame, length: Column, max_length: int = MAX_LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length)``, an entry per ``max_length`` tokens of a document."""
    n = F.greatest(F.coalesce(length, F.lit(0)).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(n / max_length).cast("long") - 1, F.lit(0))
    cut = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(max_length), F.col("n") - start).alias("length"))


def _id_type(vocabulary: ByteVocabulary) -> str:
    """Two bytes an id where the vocabulary's highest id fits, else four."""
    return "<u2" if max(vocabulary.ranks.values()) < 1 << 16 else "<i4"


def _narrow(docs: DataFrame, vocabulary: ByteVocabulary, max_length: int = MAX_LENGTH) -> DataFrame:
    """The rows of :func:`tokenised` with the ids as bytes, which is how they are stored and shuffled."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    width = np.dtype(_id_type(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for part in tables.slices(batch, "text"):
                found = [token_ids(encoder, t or "") for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in found], dtype=np.int64)
                cuts = np.maximum(1, -(-n // max_length))
                owner = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * max_length
                length = np.minimum(max_length, n[owner] - start)
                ends = np.concatenate(([0], np.cumsum(length * width.itemsize))).astype(np.int32)
                ids = np.concatenate(found).astype(width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        pa.array(piece),
                        pa.array(start),
                        pa.array(length),
                        pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, piece long, start long, length long, ids binary"
    )


def _widened(rows: DataFrame, vocabulary: ByteVocabulary) -> DataFrame:
    """The ids of :func:`_narrow` as numbers; the other columns stay as they are."""
    width, at = np.dtype(_id_type(vocabulary)), rows.columns.index("ids")
    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SENT_ROWS):
                part = batch.slice(first, SENT_ROWS)
                # Cast and joined anew, so that the offsets are of 32 bits and begin at 0.
                held = pa.concat_arrays([part.column(at).cast(pa.binary())])
                ends = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]
                data = held.buffers()[2] or b""
                ids = np.frombuffer(data, dtype=np.uint8, count=ends[-1] - ends[0], offset=ends[0]).view(width).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // width.itemsize), pa.array(ids))
                columns = [lists if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return rows.mapInArrow(run, fields)


def tokenised(docs: DataFrame, path: str = VOCABULARY, max_length: int = MAX_LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the token ids of each text, cut as :func:`pieces` does."""
    vocabulary = ByteVocabulary(path)
    return _widened(_narrow(docs, vocabulary, max_length), vocabulary)


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding, in order.

    Only lengths that occur can be ends. Of equal choices the one with fewer buckets is
    taken, then the one with smaller ends from the top down.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    m = len(lengths)
    # Tokens after padding: each bucket costs its rows times its end.
    cost = np.full(m + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    best_cost, best = None, None
    came = []
    for _ in range(min(buckets, m)):
        nxt = np.full(m + 1, np.iinfo(np.int64).max // 4)
        origin = np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            origin[j] = int(total.argmin())
            nxt[j] = total[origin[j]]
        came.append(origin)
        cost = nxt
        if best_cost is None or cost[m] < best_cost:
            best_cost, best = cost[m], len(came)
    ends, j = [], m
    for origin in reversed(came[:best]):
        ends.append(int(lengths[j - 1]))
        j = int(origin[j])
    return ends[::-1]


def packed(parts: DataFrame, token_budget: int = TOKEN_BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """Bucket, batch and padding of each piece; ``parts`` as :func:`pieces` or :func:`tokenised` gives them."""
    held_ids = [c for c in parts.columns if c == "ids"]
    # The number of a row deals rows that repeat to different groups.
    parts = tables.kept(parts.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # MAX_LENGTH + 1 rows at most
    ends = boundaries(histogram, buckets)
    if not ends:
        ends = [0]
    held = [sum(n for x, n in histogram.items() if low < x <= high) for low, high in zip([-1, *ends], ends)]
    groups = [max(1, -(-n // GROUP_ROWS)) for n in held]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("length")))
    placed = parts.withColumn("bucket", bucket)
    placed = placed.withColumns(
        {
            "boundary": of_bucket(ends).cast("long"),
            "per_batch": of_bucket([max(1, token_budget // max(1, e)) for e in ends]).cast("long"),
            "group": F.pmod(F.xxhash64("row"), of_bucket(groups)).cast("int"),
        }
    )
    in_group = Window.partitionBy("bucket", "group").orderBy("doc_id", "piece", "row")
    place = F.row_number().over(in_group) - 1
    return placed.withColumn("at", place).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "bucket",
        "boundary",
        F.concat_ws("-", "bucket", "group", F.floor(F.col("at") / F.col("per_batch"))).alias("batch"),
        (F.col("at") % F.col("per_batch")).cast("int").alias("place"),
        (F.col("boundary") - F.col("length")).alias("padding"),
        *held_ids,
    )


def batches(rows: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """``(batch, boundary, doc_ids, pieces, lengths, ids)`` from the rows of :func:`pack`.

    ``ids`` holds the batch row by row, each padded to the boundary: at most a token budget.
    """
    padding = F.array_repeat(F.lit(pad_id), F.col("padding").cast("int"))
    row = F.struct("place", "doc_id", "piece", "length", F.concat("ids", padding).alias("ids"))
    return rows.groupBy("batch", "boundary").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "batch",
        "boundary",
        F.col("rows.doc_id").alias("doc_ids"),
        F.col("rows.piece").alias("pieces"),
        F.col("rows.length").alias("lengths"),
        F.col("rows.ids").alias("ids"),
    )


def pack(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row per piece of a document: its ids, and its place in the batches."""
    vocabulary = ByteVocabulary(path)
    return _widened(packed(_narrow(docs, vocabulary)), vocabulary)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables.table(spark, sf_dir, "documents"))
