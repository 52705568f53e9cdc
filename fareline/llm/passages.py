"""Substring dedup: passages that an earlier document has, too, are removed.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window that
covers it also starts in a document with a smaller id; windows are judged on the input.

Matching statistics against suffix automata decide, exactly and on the words themselves.
The reference is the corpus itself, which grows with the input, so automata over whole
documents could neither be broadcast nor all be streamed past every document. Both sides
meet by content instead:

1. Each window has an anchor, the run of ``ANCHOR`` words in it with the smallest hash. Equal
   windows have equal anchors. Anchors that occur once in the corpus are done with.
2. Around each anchor that occurs again, a document's windows form a segment of at most
   2 * WINDOW - ANCHOR words. Equal segments become one, with the smallest id that has it.
3. Segments are sharded by anchor, so all occurrences of a window share a shard of bounded
   size. The suffix automaton of a shard holds for each state the smallest id in which its
   words occur; the shard's segments are streamed past it, and each window of length
   WINDOW gets that id. Segments whose anchor no other segment of the corpus has need neither.
   An anchor with more than ``HOT_SEGMENTS`` different segments is cut
   into its windows instead, which are grouped by their words.
4. The verdicts return to the documents, which drop the union of the windows that lost.

Null texts have no words. A document with a null id loses nothing and counts for nobody.
Rows that repeat an id count as one document: a window in one does not remove it in another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables, words

NAME = "op2_passages"
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS first_id FROM win),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM seen WHERE first_id < doc_id),
word AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY word.i) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY 1
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

WINDOW = 13
ANCHOR = 5
SHARD_SEGMENTS = 3000
HOT_SEGMENTS = 20_000


class Anchors(NamedTuple):
    """Per anchor: the text it is in, its hash, the word its first window starts at, its windows."""

    owner: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    windows: np.ndarray

    def at(self, keep: np.ndarray) -> Anchors:
        return Anchors(*(x[keep] for x in self))


def anchors(found: words.Words) -> Anchors:
    n = len(found.hashes) - WINDOW + 1
    if n <= 0:
        return Anchors(*(np.empty(0, dtype=np.int64) for _ in range(4)))
    runs = words.grams(found.hashes, ANCHOR)
    shifts = range(WINDOW - ANCHOR + 1)
    least = runs[:n].copy()
    for j in shifts:
        np.minimum(least, runs[j : j + n], out=least)
    place = np.zeros(n, dtype=np.int64)
    for j in reversed(shifts):  # the leftmost of equal hashes
        place[runs[j : j + n] == least] = j
    owner = found.owner
    start = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    at = place[start] + start
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    windows = np.diff(np.append(begins, len(at)))
    first = start[begins]
    return Anchors(owner[first], words.signed(runs[at[begins]]), first - found.bounds[owner[first]], windows)


def _segment(in_order: list[bytes], first: int, windows: int) -> bytes:
    return b" ".join(in_order[first : first + windows + WINDOW - 1])


def _id(segment: bytes) -> int:
    """The hash that Spark's ``xxhash64`` gives, as a signed number."""
    h = xxhash.xxh64_intdigest(segment, seed=42)
    return h - (1 << 64) if h >> 63 else h


def _anchored(docs: DataFrame, with_id: bool) -> DataFrame:
    """``(anchor[, doc_id])`` once per document and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.slices(batch, "text"):
                found = anchors(words.split(tables.texts(part, "text")))
                order = np.lexsort((found.owner, found.hashes))
                h, owner = found.hashes[order], found.owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                out = [pa.array(h[new])]
                if with_id:
                    out.append(part.column(0).take(pa.array(owner[new])))
                yield pa.RecordBatch.from_arrays(out, ["anchor", "doc_id"][: len(out)])

    return docs.mapInArrow(run, "anchor long, doc_id long" if with_id else "anchor long")


def _occurrences(docs: DataFrame) -> DataFrame:
    """The segments of ``docs(doc_id, text, wanted)`` around the wanted anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.slices(batch, "text"):
                raw = tables.texts(part, "text")
                found = anchors(words.split(raw))
                wanted = part.column(2)
                ids = part.column(0).to_pylist()
                cuts = np.searchsorted(found.owner, np.arange(len(raw) + 1))
                rows: list[tuple] = []
                for i, text in enumerate(raw):
                    mine = found.at(slice(cuts[i], cuts[i + 1]))
                    good = np.isin(mine.hashes, wanted[i].values.to_numpy())
                    in_order = text.split()
                    for h, first, n in zip(*(x[good].tolist() for x in mine[1:]), strict=True):
                        segment = _segment(in_order, first, n)
                        rows.append((h, _id(segment), ids[i], segment.decode()))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "segment_id", "doc_id", "segment"]
                )

    return docs.mapInArrow(run, "anchor long, segment_id long, doc_id long, segment string")


class SuffixAutomaton:
    """Of many word sequences; each state knows the smallest id in which its words occur."""

    NOBODY = (1 << 63) - 1

    def __init__(self) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [self.NOBODY]

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(self.NOBODY)
        return len(self.moves) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """Part the state reached from ``p`` so that its longest word is one longer than ``p``'s."""
        clone = self._state(self.length[p] + 1, dict(self.moves[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        q = self.moves[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, sequence: list[str], doc_id: int) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)
            self.least[last] = min(self.least[last], doc_id)

    def finish(self) -> None:
        """Hand the smallest ids to the states of shorter suffixes."""
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True):
            above = self.link[state]
            self.least[above] = min(self.least[above], self.least[state])

    def least_ids(self, sequence: list[str], window: int = WINDOW) -> list[int]:
        """For each window of the sequence the smallest id that holds it."""
        state = matched = 0
        out = []
        for i, word in enumerate(sequence):
            while state and word not in self.moves[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.moves[state]:
                state, matched = self.moves[state][word], matched + 1
            while self.length[self.link[state]] >= window and state:
                state = self.link[state]
                matched = self.length[state]
            if i >= window - 1:
                out.append(self.least[state] if matched >= window else self.NOBODY)
        return out


_VERDICT = "anchor long, segment_id long, least array<long>"


def _by_automaton(segments: DataFrame, shards: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        ids = rows["doc_id"].tolist()
        # A segment that shares its anchor with no other has nothing to match but itself.
        alone = (~rows["anchor"].duplicated(keep=False)).tolist()
        split = [s.split(" ") for s in rows["segment"]]
        for sequence, doc_id, single in zip(split, ids, alone, strict=True):
            if not single:
                automaton.add(sequence, doc_id)
        automaton.finish()
        least = [
            [doc_id] * (len(sequence) - WINDOW + 1) if single else automaton.least_ids(sequence)
            for sequence, doc_id, single in zip(split, ids, alone, strict=True)
        ]
        return pd.DataFrame({"anchor": rows["anchor"], "segment_id": rows["segment_id"], "least": least})

    sharded = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(run, _VERDICT)


def _by_window(segments: DataFrame) -> DataFrame:
    """The same verdicts for anchors with too many segments for one shard."""
    split = F.split("segment", " ")
    each = F.transform(
        F.sequence(F.lit(1), F.size(split) - (WINDOW - 1)), lambda i: F.array_join(F.slice(split, i, WINDOW), " ")
    )
    windows = tables.kept(
        segments.select("anchor", "segment_id", "doc_id", F.posexplode(each).alias("i", "window")), "passages-windows"
    )
    least = tables.kept(windows.groupBy("window").agg(F.min("doc_id").alias("least")), "passages-least")
    told = windows.drop("doc_id").join(least, "window").groupBy("anchor", "segment_id")
    in_order = F.sort_array(F.collect_list(F.struct("i", "least")))
    return told.agg(in_order.getField("least").alias("least"))


def _verdicts(segments: DataFrame) -> DataFrame:
    """For each segment the smallest ids that hold its windows."""
    per_anchor = segments.groupBy("anchor").count()
    hot = tables.kept(per_anchor.filter(F.col("count") > HOT_SEGMENTS).select("anchor"), "passages-hot")
    shards = max(1, -(-segments.count() // SHARD_SEGMENTS))
    if hot.isEmpty():
        return _by_automaton(segments, shards)
    return _by_automaton(segments.join(hot, "anchor", "left_anti"), shards).unionByName(
        _by_window(segments.join(hot, "anchor", "left_semi"))
    )


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, marks)``: which windows of which segments of a document an earlier one has."""
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = tables.kept(
        _anchored(docs.select("text"), False).groupBy("anchor").count().filter("count > 1").select("anchor"), "passages-again"
    )
    wanted = tables.kept(
        _anchored(docs, True).join(again, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted")),
        "passages-wanted",
    )
    found = tables.kept(_occurrences(docs.join(wanted, "doc_id")), "passages-found")
    segments = tables.kept(
        found.groupBy("anchor", "segment_id", "segment").agg(F.min("doc_id").alias("doc_id")), "passages-segments"
    )
    told = tables.kept(_verdicts(segments), "passages-verdicts")
    place = F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    lost = F.aggregate(place, F.lit(0), lambda a, b: a + b)
    marks = found.select("anchor", "segment_id", "doc_id").distinct().join(told, ["anchor", "segment_id"])
    return marks.select("doc_id", F.struct("anchor", "segment_id", lost.alias("lost")).alias("mark")).filter(
        "mark.lost > 0"
    ).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def _removed(in_order: list[bytes], found: Anchors, marks: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The spans of words, first and last plus one, that go; ``found`` are the text's anchors."""
    gone = np.zeros(len(in_order) + 1, dtype=np.int64)
    good = np.isin(found.hashes, np.fromiter({a for a, _ in marks}, dtype=np.int64))
    for h, first, n in zip(*(x[good].tolist() for x in found[1:]), strict=True):
        lost = marks.get((h, _id(_segment(in_order, first, n))), 0)
        for i in range(n):
            if lost >> i & 1:
                gone[first + i] += 1
                gone[first + i + WINDOW] -= 1
    starts, ends = words.spans(np.cumsum(gone[:-1]) > 0)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


_CLEAN = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"


def cleaned(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document the words that stay and the spans of word places that went (last exclusive).

    ``kept_text`` holds the words that stay, joined by one space; ``with_text=False`` leaves it out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = tables.kept(repeated(docs), "passages-marks")
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.slices(batch, "text"):
                rows = []
                raw = tables.texts(part, "text")
                marked = [bool(told) for told in part.column(2).is_valid().to_pylist()]
                # One pass over all texts that lose something; the others need no anchors.
                found = anchors(words.split([t for t, m in zip(raw, marked, strict=True) if m]))
                cuts = np.searchsorted(found.owner, np.arange(sum(marked) + 1)).tolist()
                nth = 0
                for text, told in zip(raw, part.column(2).to_pylist(), strict=True):
                    in_order, spans = text.split(), []
                    if told is not None:
                        mine = found.at(slice(cuts[nth], cuts[nth + 1]))
                        spans = _removed(in_order, mine, {(m["anchor"], m["segment_id"]): m["lost"] for m in told})
                        nth += 1
                    left, done = [], 0
                    for first, last in spans:
                        left += in_order[done:first]
                        done = last
                    left += in_order[done:]
                    joined = b" ".join(left)
                    rows.append(
                        (len(in_order), len(in_order) - len(left), hashlib.sha256(joined).hexdigest(),
                         [{"first": a, "last": b} for a, b in spans], joined.decode() if with_text else None)
                    )
                kinds = [pa.int64(), pa.int64(), pa.string(), span, pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
                n = 6 if with_text else 5
                yield pa.RecordBatch.from_arrays([part.column(0), *columns][:n], names[:n])

    return docs.join(marks, "doc_id", "left").mapInArrow(run, _CLEAN + (", kept_text string" if with_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(tables.table(spark, sf_dir, "documents"), with_text=False).drop("spans")
