"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Both vocabularies cut the bytes of a space and the text into tokens; a token is known by
where it ends. The shorter list of ends drives a galloping search: steps that double from
where the end should lie until they pass it, then a binary search inside the last step. Ends
that both lists hold slice the tokens into groups, and the difference of the ranks of two
neighbouring ends says which tokens of the longer list a token of the shorter overlaps. The
searches of all ends of many texts run in step, as array operations.

How often two ids overlap is counted over the whole corpus. Texts are handled in blocks; a
block keeps, per document, its different id pairs and how often they occur, and asks for the
corpus-wide count of each of its pairs once. Those questions meet the counts by a join on the
pair, where no pair comes more than once a block, and go back to their block. Neither the
counts nor the documents are ever in one place; a block is bounded by ``BLOCK_BYTES`` of text
or one text, and about ``CHUNK_CHARS`` or one part of a text are in work at a time. Between the steps
a document is a row and a pair of a block is a row: Spark never holds a block as one value, and
a block's answers come to its documents in order, as a stream.

A text that is null or empty, or whose bytes one of the vocabularies does not give back, has
no tokens: counts of zero and an empty digest. Strings of special tokens are ordinary text.
Rows that repeat, null ids included, are aligned one by one. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from fareline.llm import tables
from fareline.llm.swap_packing import ByteVocabulary, parts_of

NAME = "op13_alignment"
ORACLE = None  # two tokenizers: checked against every pair of tokens

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
BLOCK_BYTES = 2 << 20
CHUNK_CHARS = 1 << 18
#: Documents go to a task by so many bytes at a time: a block, unless the last of them is long.
BATCH_BYTES = BLOCK_BYTES - (64 << 10)
#: Pairs of a block go out by so many rows at a time.
PAIR_ROWS = 1 << 16
#: Every so many ends one is looked up from afar; those between start from their neighbours.
STRIDE = 32


# ---- the search -------------------------------------------------------------


def gallop(keys: np.ndarray, into: np.ndarray, near: np.ndarray) -> np.ndarray:
    """How many of ``into`` lie below each key; the search of a key starts at its ``near``."""
    n = len(into)
    if not n:
        return np.zeros(len(keys), dtype=np.int64)
    near = np.clip(near, 0, n - 1)
    up = into[near] < keys
    low = np.where(up, near + 1, 0)
    high = np.where(up, n, near)
    sign = np.where(up, 1, -1)
    lanes, step = np.arange(len(keys)), 1
    while len(lanes):  # double the step until the key is passed
        probe = near[lanes] + sign[lanes] * step
        inside = (probe >= 0) & (probe < n)
        lanes, probe = lanes[inside], probe[inside]
        below = into[probe] < keys[lanes]
        low[lanes[below]] = probe[below] + 1
        high[lanes[~below]] = probe[~below]
        lanes = lanes[below == up[lanes]]
        step *= 2
    lanes = np.flatnonzero(low < high)
    while len(lanes):  # halve what is left
        middle = (low[lanes] + high[lanes]) >> 1
        below = into[middle] < keys[lanes]
        low[lanes[below]] = middle[below] + 1
        high[lanes[~below]] = middle[~below]
        lanes = lanes[low[lanes] < high[lanes]]
    return low


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many ends of the longer list lie below each end of the shorter."""
    at = np.arange(0, len(short), STRIDE)
    far = gallop(short[at], long, at * len(long) // max(1, len(short)))
    first = np.arange(len(short)) // STRIDE
    after = np.append(far[1:], len(long))
    inside = np.arange(len(short)) - first * STRIDE
    return gallop(short, long, far[first] + inside * (after - far)[first] // STRIDE)


class Cuts(NamedTuple):
    """What the ends of two token lists over the same bytes have to do with each other.

    ``a_last`` and ``b_last``: the last token of each group. ``a_link`` and ``b_link``: the
    pairs of tokens that overlap, in order.
    """

    a_last: np.ndarray
    b_last: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> Cuts:
    turned = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if turned else (a_ends, b_ends)
    rank = ranks(short, long)
    common = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(0, dtype=bool)
    # A token reaches from the rank behind the end before it to the rank of its own end.
    first = np.concatenate(([0], (rank + common)[:-1]))[: len(short)]
    many = rank - first + 1
    before = np.cumsum(many) - many
    short_link = np.repeat(np.arange(len(short)), many)
    long_link = np.arange(len(short_link)) - np.repeat(before - first, many)
    short_last = np.flatnonzero(common)
    found = (short_last, rank[short_last]), (short_link, long_link)
    (a_last, b_last), (a_link, b_link) = ((y, x) if turned else (x, y) for x, y in found)
    return Cuts(a_last, b_last, a_link, b_link)


# ---- the vocabularies -------------------------------------------------------


class Coders:
    """Both tokenizers and the bytes of their tokens. Made anew in each task, from the files' contents."""

    def __init__(self, entries: ByteVocabulary, model: bytes) -> None:
        self.entries = entries.encoder()
        self.a_bytes = [b""] * (1 + max(entries.ranks.values()))
        for token, i in entries.ranks.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b_bytes = [
            bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)
        ]
        #: Only where marks stand at the front of pieces does a text fall apart before a space.
        self.parted = not any(MARK in t.lstrip(MARK) for t in names)
        self.a_widths = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_widths = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.n_a, self.n_b = len(self.a_bytes), n
        # A token opens its group or follows another; the digest joins these texts.
        a, b = map(str, range(self.n_a)), [str(i) for i in range(n)]
        a = list(a)
        self.spelled = [*[";" + t for t in a], *["," + t for t in a], *["|" + t for t in b], *["," + t for t in b]]

    def encode(self, part: str, first: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a part of a text by both, none if one of them does not give its bytes back."""
        spaced = " " + part if first else part  # later parts begin with a space
        a = self.entries.encode_ordinary(spaced)
        b = self.pieces.encode(spaced[1:])
        raw = spaced.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)) if same else None


class Block(NamedTuple):
    """Texts with their counts, digests and id pairs.

    ``totals``: tokens of either kind, groups and links of each text. ``ends``: where the pairs
    of each text end in ``place`` and ``times``, which say which of ``pairs`` it has how often.
    ``counts``: how often each pair occurs in the block.
    """

    totals: np.ndarray
    digests: list[str]
    ends: np.ndarray
    place: np.ndarray
    times: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def _chunk(coders: Coders, units: list[tuple[int, np.ndarray, np.ndarray]], totals: np.ndarray, digests: list) -> np.ndarray:
    """Align the parts of texts in ``units``; the keys of (text, pair) and how often each occurs."""
    a = np.concatenate([u[1] for u in units]).astype(np.int64)
    b = np.concatenate([u[2] for u in units]).astype(np.int64)
    owner = np.array([u[0] for u in units])
    # Both lists end every part at the same byte, so the ends of all parts make one list.
    found = cuts(np.cumsum(coders.a_widths[a]), np.cumsum(coders.b_widths[b]))
    a_stop, b_stop = np.cumsum([len(u[1]) for u in units]), np.cumsum([len(u[2]) for u in units])
    group_stop = np.searchsorted(found.a_last, a_stop - 1, side="right")
    link_stop = np.searchsorted(found.a_link, a_stop)
    numbers = np.stack([np.diff(s, prepend=0) for s in (a_stop, b_stop, group_stop, link_stop)], axis=1)
    np.add.at(totals, owner, numbers)

    # Groups one after another: the tokens of a before those of b.
    def openers(last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        opens = np.zeros(n, dtype=bool)
        opens[0] = True
        opens[last[:-1] + 1] = True
        return opens, np.cumsum(opens) - 1

    a_opens, a_group = openers(found.a_last, len(a))
    b_opens, b_group = openers(found.b_last, len(b))
    spelled = np.empty(len(a) + len(b), dtype=np.int64)
    spelled[np.arange(len(a)) + np.concatenate(([0], found.b_last[:-1] + 1))[a_group]] = a + np.where(a_opens, 0, coders.n_a)
    spelled[np.arange(len(b)) + (found.a_last + 1)[b_group]] = b + 2 * coders.n_a + np.where(b_opens, 0, coders.n_b)
    words = list(map(coders.spelled.__getitem__, spelled.tolist()))
    start = 0
    for text, stop in zip(owner.tolist(), (a_stop + b_stop).tolist(), strict=True):
        out = "".join(words[start:stop])
        if digests[text] is None:
            digests[text], out = hashlib.sha256(), out[1:]
        digests[text].update(out.encode())
        start = stop

    owners = np.repeat(owner, numbers[:, 3])
    pair = b[found.b_link] * coders.n_a + a[found.a_link]
    keys, many = np.unique(owners * (coders.n_a * coders.n_b) + pair, return_counts=True)
    return np.stack([keys, many])


def align(coders: Coders, texts: list[str | None]) -> Block:
    """Align the tokens of each text."""
    totals = np.zeros((len(texts), 4), dtype=np.int64)
    digests: list = [None] * len(texts)
    refused: set[int] = set()
    found, units, chars = [], [], 0

    def finish() -> None:
        nonlocal units, chars
        if units:
            found.append(_chunk(coders, units, totals, digests))
        units, chars = [], 0

    for i, text in enumerate(texts):
        parts = parts_of(text) if coders.parted else iter([text])
        for k, part in enumerate(parts if text else ()):
            ids = coders.encode(part, k == 0)
            if ids is None:
                refused.add(i)
                break
            units.append((i, *ids))
            chars += len(part)
            if chars >= CHUNK_CHARS:
                finish()
    finish()
    everything = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    size = coders.n_a * coders.n_b
    if refused:
        out = sorted(refused)
        totals[out] = 0
        for i in out:
            digests[i] = None
        everything = everything[:, ~np.isin(everything[0] // size, out)]
    keys, at = np.unique(everything[0], return_inverse=True)  # a text in several chunks has its pairs in each
    times = np.zeros(len(keys), dtype=np.int64)
    np.add.at(times, at, everything[1])
    pairs, place = np.unique(keys % size, return_inverse=True)
    counts = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(counts, place, times)
    ends = np.searchsorted(keys // size, np.arange(len(texts)), side="right")
    return Block(totals, [d.hexdigest() if d else "" for d in digests], ends, place, times, pairs, counts)


# ---- over the corpus --------------------------------------------------------

_TOTALS = ["n_a", "n_b", "n_groups", "n_links"]


def _coders(byte_vocabulary: str, pieces: str) -> tuple[ByteVocabulary, bytes]:
    """What tasks make their coders of; read once, by the driver."""
    with open(pieces, "rb") as f:
        return ByteVocabulary(byte_vocabulary), f.read()


def packed(values: np.ndarray) -> bytes:
    """Numbers of 0 to 2^64 - 1 by as few bytes each as the largest needs; the first byte says how many."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def blocks(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """The blocks in the shared work folder: a row per pair of a block and a row per document.

    ``pair`` and ``count``: how often a pair occurs in the block; null for a document. ``place``
    (as steps from one to the next) and ``times``: which of the block's pairs, in ascending order,
    a document has how often; null for a pair.
    """
    id_type = docs.schema["doc_id"].dataType
    made_of = _coders(byte_vocabulary, pieces)
    kinds = {"pair": pa.int64(), "count": pa.int64(), "doc_id": None, **{n: pa.int64() for n in _TOTALS}}
    kinds |= {"digest": pa.string(), "place": pa.binary(), "times": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(*made_of)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in tables.slices(batch, "text", BLOCK_BYTES):

                def rows(n: int, part=part, number=number, **filled: pa.Array) -> pa.RecordBatch:
                    of = {name: part.column(0).type if kind is None else kind for name, kind in kinds.items()}
                    columns = [filled[name] if name in filled else pa.nulls(n, kind) for name, kind in of.items()]
                    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *columns], ["block", *kinds])

                b = align(coders, part.column(1).to_pylist())
                for at in range(0, len(b.pairs), PAIR_ROWS):
                    pairs, counts = b.pairs[at : at + PAIR_ROWS], b.counts[at : at + PAIR_ROWS]
                    yield rows(len(pairs), pair=pa.array(pairs), count=pa.array(counts))
                spans = list(zip([0, *b.ends[:-1].tolist()], b.ends.tolist(), strict=True))
                seen = {
                    "place": pa.array([packed(np.diff(b.place[i:j], prepend=0)) for i, j in spans], pa.binary()),
                    "times": pa.array([packed(b.times[i:j]) for i, j in spans], pa.binary()),
                }
                totals = {name: pa.array(t) for name, t in zip(_TOTALS, b.totals.T, strict=True)}
                yield rows(part.num_rows, doc_id=part.column(0), digest=pa.array(b.digests, pa.string()), **totals, **seen)
                number += 1

    types = [("block", LongType()), ("pair", LongType()), ("count", LongType()), ("doc_id", id_type)]
    types += [*((n, LongType()) for n in _TOTALS), ("digest", StringType()), ("place", BinaryType()), ("times", BinaryType())]
    found = docs.select("doc_id", "text").mapInArrow(run, StructType([StructField(*t) for t in types]))
    return tables.kept(found, "alignment-blocks", batch_bytes=BATCH_BYTES)


def pair_counts(blocks: DataFrame, n_a: int) -> DataFrame:
    """``(pair, a_id, b_id, n, best)``: links that hold two ids together, over all blocks.

    ``best``: no other id has more links with this ``b_id``.
    """
    each = blocks.where("pair is not null").select("pair", "count")
    counted = tables.kept(
        each.groupBy("pair").agg(F.sum("count").alias("n")).select(
            "pair", (F.col("pair") % n_a).alias("a_id"), F.floor(F.col("pair") / n_a).cast("long").alias("b_id"), "n"
        ),
        "alignment-counts",
    )
    most = tables.kept(counted.groupBy("b_id").agg(F.max("n").alias("most")), "alignment-most")
    return counted.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """Counts and digest of the alignment of each document."""
    found = blocks(docs, byte_vocabulary, pieces)
    n_a = 1 + max(ByteVocabulary(byte_vocabulary).ranks.values())
    rated = tables.kept(pair_counts(found, n_a), "alignment-rated")
    asked = found.where("pair is not null").select("block", "pair")
    told = asked.join(rated.select("pair", "n", "best"), "pair").select("block", "pair", "n", "best")
    texts = found.where("pair is null").drop("pair", "count")
    both = told.unionByName(texts, allowMissingColumns=True)
    # A block's answers in the order of its pairs, then its documents.
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("pair").asc_nulls_last())
    id_type = docs.schema["doc_id"].dataType
    names = [*_TOTALS, "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answers, n, best = None, [], None, None
        for batch in batches:
            of = batch["block"].to_numpy()
            text = batch["pair"].is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(of) != 0) | (text[1:] != text[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(of)], strict=True):
                rows = batch.slice(start, stop - start)
                if of[start] != block:
                    block, answers, n, best = of[start], [], None, None
                if not text[start]:
                    answers.append((rows["n"].to_numpy(), rows["best"].to_numpy(zero_copy_only=False)))
                    continue
                if n is None:
                    zero = np.zeros(0, dtype=np.int64)
                    n, best = (np.concatenate([zero, *x]) for x in (zip(*answers, strict=True) if answers else ([], [])))
                    answers = []
                sums = np.zeros((2, stop - start), dtype=np.int64)
                for i, (steps, often) in enumerate(zip(rows["place"].to_pylist(), rows["times"].to_pylist(), strict=True)):
                    place, times = np.cumsum(unpacked(steps)), unpacked(often)
                    sums[:, i] = times @ best[place], times @ n[place]
                columns = [rows["doc_id"], *(rows[t] for t in _TOTALS), *map(pa.array, sums), rows["digest"]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "groups_sha256"])

    schema = StructType(
        [StructField("doc_id", id_type), *(StructField(n, LongType()) for n in names), StructField("groups_sha256", StringType())]
    )
    return dealt.mapInArrow(run, schema)


def groups(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, pieces: str = PIECES) -> DataFrame:
    """The alignment itself: a row per document with its groups, ``(a, b)`` lists of ids that cover the same bytes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made_of = _coders(byte_vocabulary, pieces)

    def of(coders: Coders, text: str | None) -> list[dict]:
        parts = list(parts_of(text) if coders.parted else [text]) if text else []
        ids = [coders.encode(p, k == 0) for k, p in enumerate(parts)]
        if not ids or None in ids:
            return []
        out = []
        for a, b in ids:
            found = cuts(np.cumsum(coders.a_widths[a]), np.cumsum(coders.b_widths[b]))
            i = j = 0
            for p, q in zip(found.a_last.tolist(), found.b_last.tolist(), strict=True):
                out.append({"a": a[i : p + 1].tolist(), "b": b[j : q + 1].tolist()})
                i, j = p + 1, q + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Coders(*made_of)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for part in tables.slices(batch, "text"):
                found = [of(coders, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "groups"])

    schema = f"doc_id {id_type}, groups array<struct<a: array<int>, b: array<int>>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(tables.table(spark, sf_dir, "documents"))
