"""Best-fit packing of whole documents by a local search of swaps.

A document is its token ids and an end id. Only a document longer than ``CAPACITY`` is cut,
into pieces of ``CAPACITY`` ids; the first piece takes what is left over and may be shorter.
Full pieces are sequences of their own. All others are dealt by hash to groups of about
``GROUP_ROWS`` pieces. In a group best fit, longest first, gives the bins to start from. Then
the emptiest bins give documents to the fuller ones: a move, one document for one, two for
one or one for two, whichever fills the taker most. Each exchange makes the sum of squared
fills rise. Where none is left, more of the emptier bins give, up to all but the fullest; the
search ends when they have nothing to give either or the bins are as few as their tokens allow.

Bins that are still underfull go to a next round with the underfull bins of other groups, in
new and fewer groups, as long as that saves sequences. The groups have a bounded size in every
round, whatever the table holds.

A null or empty text is the end id alone. Rows that repeat, null ids included, are packed one
by one. Strings of special tokens in a text are ordinary text. An empty table gives no row.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op12_swap_packing"
ORACLE = None  # a local search over token counts: checked by what a packing must hold, and against every packing of few

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 16_384
#: The emptiest bins that give documents at a time.
GIVERS = 24
#: Another round over the underfull bins must save one sequence in so many.
WORTH = 200


# ---- token ids --------------------------------------------------------------


def byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    """The entries of a byte-level merge vocabulary as bytes, and an encoder of ordinary text.

    Such a vocabulary numbers its entries in the order of its merges, so the ids are the ranks
    that the encoder asks for; a file where that does not hold is refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = byte_of_character()
        special = {t["id"] for t in model["added_tokens"]}
        self.ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
        ids = [model["model"]["vocab"][t] for t in merged]
        if ids != sorted(ids) or model["normalizer"] or len(self.ranks) != 256 + len(ids):
            raise ValueError(f"{path}: ids are not the order of merges")

    def encoder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})


#: A text is cut where a letter is followed by a space and a letter: no token crosses such a place.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
PART_CHARS = 1 << 18


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """A text in parts of about ``size`` characters whose ids together are the text's.

    A run without such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def token_ids(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.concatenate([np.array(encoder.encode_ordinary(p), dtype="<u4") for p in parts_of(text)])


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECE = "piece int, start long, length long, ids_crc32 long, ids array<int>"


def encoded(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)``; the ids only if they are asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = ByteVocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for part in tables.slices(batch, "text"):
                owner, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(encoder, text or ""), np.array([END_ID], dtype="<u4"))
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        piece = ids[start : start + length]
                        owner.append(i)
                        rows.append((k, start, length, zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {_PIECE}")


# ---- the search inside a group ----------------------------------------------


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers: each row, longest first, goes to the bin that it fills most."""
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []
    for row in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[row])
        at = bisect_left(gaps, n)
        if at == len(gaps):
            home, gap = len(bins), capacity
            bins.append([])
        else:
            gap = gaps[at]
            home = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
        bins[home].append(row)
        left = gap - n
        if left:
            if not by_gap.setdefault(left, []):
                insort(gaps, left)
            by_gap[left].append(home)
    return bins


class Exchanges:
    """The documents of the emptiest bins, by length, and what a fuller bin can best take of them."""

    def __init__(self, bins: list[list[int]], lengths: list[int], givers: list[int]) -> None:
        self.bins, self.lengths = bins, lengths
        self.singles: list[tuple[int, int, int]] = []  # (length, row, bin)
        self.pairs: list[tuple[int, int, int, int]] = []  # (length of both, row, row, bin)
        for b in givers:
            self.enter(b)

    def _of(self, b: int) -> tuple[list, list]:
        rows = sorted(self.bins[b])
        size = self.lengths
        singles = [(size[r], r, b) for r in rows]
        # Bins of many small documents pair each with the next few only, by length: moves reach the rest.
        ordered = sorted(rows, key=size.__getitem__)
        pairs = [(size[r] + size[q], r, q, b) for i, r in enumerate(ordered) for q in ordered[i + 1 : i + 9]]
        return singles, pairs

    def enter(self, b: int) -> None:
        singles, pairs = self._of(b)
        for x in singles:
            insort(self.singles, x)
        for x in pairs:
            insort(self.pairs, x)

    def leave(self, b: int) -> None:
        singles, pairs = self._of(b)
        for x in singles:
            self.singles.pop(bisect_left(self.singles, x))
        for x in pairs:
            self.pairs.pop(bisect_left(self.pairs, x))

    def best(self, taker: int, gap: int) -> tuple[int, list[int], list[int], int] | None:
        """The gain, the rows that go out, those that come in and the giver; none if nothing gains."""
        found, top = None, 0
        size, rows = self.lengths, self.bins[taker]
        high = (1 << 60,)

        def offer(source: list, out: list[int]) -> None:
            nonlocal found, top
            gone = sum(size[r] for r in out)
            at = bisect_right(source, (gone + gap, *high)) - 1
            if at >= 0 and source[at][0] - gone > top:
                top = source[at][0] - gone
                found = (top, out, list(source[at][1:-1]), source[at][-1])

        ordered = sorted(rows, key=size.__getitem__)
        offer(self.singles, [])
        offer(self.pairs, [])
        for i, r in enumerate(ordered):
            if top == gap:
                break
            offer(self.singles, [r])
            offer(self.pairs, [r])
            for q in ordered[i + 1 : i + 9]:
                offer(self.singles, [r, q])
        return found


def search(lengths: np.ndarray, capacity: int = CAPACITY, givers: int = GIVERS) -> np.ndarray:
    """The bin of each row, numbered from 0: best fit, then swaps until no bin can be emptied."""
    if not len(lengths):
        return np.empty(0, dtype=np.int64)
    bins = best_fit(lengths, capacity)
    size = lengths.tolist()
    fill = [sum(size[r] for r in b) for b in bins]
    least = -(-int(lengths.sum()) // capacity)
    open_bins = [b for b in range(len(bins)) if fill[b] < capacity]
    n_bins = len(bins)
    gained = True
    while n_bins > least:
        open_bins = sorted((b for b in open_bins if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        if not gained:  # more bins give before the search ends
            if givers >= len(open_bins) - 1:
                break
            givers *= 4
        gained = False
        n_giving = max(1, min(givers, len(open_bins) - 1))
        giving = open_bins[-n_giving:]
        takers = [(-fill[b], b) for b in open_bins[:-n_giving]]
        store = Exchanges(bins, size, giving)
        heapq.heapify(takers)
        while takers and n_bins > least:
            _, taker = heapq.heappop(takers)
            while fill[taker] < capacity:
                change = store.best(taker, capacity - fill[taker])
                if change is None:
                    break
                gain, out, into, giver = change
                if fill[taker] + gain <= fill[giver]:  # squares would not rise
                    break
                store.leave(giver)
                for r in into:
                    bins[giver].remove(r)
                for r in out:
                    bins[taker].remove(r)
                bins[giver] += out
                bins[taker] += into
                fill[taker] += gain
                fill[giver] -= gain
                gained = True
                if fill[giver]:
                    store.enter(giver)
                else:
                    n_bins -= 1
        # The givers among themselves: best fit of what they still hold, if that is better.
        rows = [r for b in giving for r in bins[b]]
        again = best_fit(lengths[rows], capacity) if rows else []
        fills = [int(lengths[[rows[i] for i in mine]].sum()) for mine in again]
        held = [fill[b] for b in giving if fill[b]]
        if (len(again), -sum(f * f for f in fills)) < (len(held), -sum(f * f for f in held)):
            gained = True
            n_bins -= len(held) - len(again)
            spare = len(giving) - len(again)
            for b, mine, f in zip(giving, [*again, *[[]] * spare], [*fills, *[0] * spare], strict=True):
                bins[b], fill[b] = [rows[i] for i in mine], f
    home = np.empty(len(lengths), dtype=np.int64)
    for number, b in enumerate(b for b in bins if b):
        home[b] = number
    return home


# ---- rounds over all groups ---------------------------------------------------


def _placed(rows: DataFrame, dealt_by: str, groups: int, turn: int, capacity: int) -> DataFrame:
    """Every row with its sequence, the place in it and how full it is.

    A sequence is named by the smallest key of its rows. A group that comes out with more
    sequences than it came with keeps those it had.
    """
    schema = rows.schema

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy().astype(np.int64)
        keys = group["key"].to_numpy()
        order = np.argsort(keys, kind="stable")  # the result must not depend on the order of arrival
        lengths, keys = lengths[order], keys[order]
        home = search(lengths, capacity)
        if turn:
            _, had = np.unique(group["sequence_id"].to_numpy()[order], return_inverse=True)
            if had.max() <= home.max():
                home = had
        by_bin = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.diff(home[by_bin], prepend=-1))
        sizes = np.diff(np.append(starts, len(home)))
        before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
        table = group.take(pa.array(order[by_bin])).select(["key", *carried])
        fill = np.add.reduceat(lengths[by_bin], starts)
        for name, values in (
            ("sequence_id", np.repeat(keys[by_bin][starts], sizes)),
            ("offset", before - np.repeat(before[starts], sizes)),
            ("fill", np.repeat(fill, sizes)),
        ):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    carried = [n for n in schema.names if n not in ("key", "sequence_id", "offset", "fill")]
    out = rows.select("key", *carried).schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")
    group = F.pmod(F.xxhash64(dealt_by, F.lit(turn)), F.lit(groups))
    return rows.groupBy(group.alias("group")).applyInArrow(run, out)


def placed(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int | None = None) -> DataFrame:
    """``pieces`` as :func:`encoded` gives them, each with ``sequence_id`` and ``offset``."""
    group_rows = group_rows or GROUP_ROWS
    pieces = tables.kept(pieces.withColumn("key", F.monotonically_increasing_id()), "swap-pieces")
    whole = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("key"), "offset": F.lit(0).cast("long"), "fill": F.lit(capacity).cast("long")}
    )
    rows, dealt_by, turn = pieces.filter(F.col("length") < capacity), "key", 0
    out, n, had = whole, rows.count(), None
    while n:
        groups = -(-n // group_rows)
        now = tables.kept(_placed(rows, dealt_by, groups, turn, capacity), "swap-placed")
        under = now.filter(F.col("fill") < capacity)
        bins, n = under.agg(F.count_distinct("sequence_id"), F.count(F.lit(1))).first()
        full = now.filter((F.col("fill") == capacity) & (F.col("offset") == 0)).count() if turn else 0
        if groups == 1 or (turn and (had - bins - full) * WORTH < had):
            return out.unionByName(now)
        out = out.unionByName(now.filter(F.col("fill") == capacity))
        rows, dealt_by, turn, had = under, "sequence_id", turn + 1, bins
    return out


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document: what it holds and where it lies.

    With ``with_ids`` the column ``ids`` holds the token ids, see :func:`sequences`.
    """
    pieces = encoded(docs, path, capacity, with_ids)
    rows = placed(pieces if with_ids else pieces.drop("ids"), capacity)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, starts)`` for training: the ids of a sequence in order, and where its pieces begin."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables.table(spark, sf_dir, "documents"))
