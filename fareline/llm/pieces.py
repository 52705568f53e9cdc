"""SentencePiece encoding and decoding with the pieces and scores of a model file.

An Aho-Corasick automaton over the pieces reads the text once. The pieces that end at a
character come over its output links, longest first, and relax what is known of that place:

* unigram models: the best sum of scores of a way to cut the text up to there. A character
  that is no piece by itself may stand alone for ten less than the worst score. Of equal
  sums the longer last piece wins.
* merge models (BPE, whose scores are ranks of merges): the sum of ranks says nothing about
  the order of merges, and its best way to cut differs from the library's ids for most words.
  There a piece is admitted if merging it together with the piece before it leaves just
  these two; exactly one piece is admitted at a place, and the chain of admitted pieces is
  what merging the whole text gives.

Characters without a piece become their bytes' pieces, or ``<unk>`` where the model has none.

White space marks cut the work: where every piece has its marks at the front, the search
falls apart at each mark after another character, and at each line feed that no longer
piece holds. Such stretches repeat, so the ids of the latest are remembered; memory stays
bounded and the result is the same as for the whole text.

Null and empty texts have no ids. Decoding gives the text back, but for what ``<unk>`` and
white space marks in the text itself stand for.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op1_pieces"
ORACLE = None  # a search over a vocabulary: checked against the library's unigram model and by round trip

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000
ADMITTED = 400_000
#: Longer stretches are not remembered.
REMEMBERED_CHARS = 40


class Codec:
    """Encoder and decoder of one model; holds no library object, so it can be handed to tasks."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED, merges: bool | None = None) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.texts = [lib.id_to_piece(i) for i in range(n)]
        self.lengths = [len(t) for t in self.texts]
        self.unknown = lib.unk_id()
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.control = special - set(self.bytes.values()) - {self.unknown}
        self.scores = {self.texts[i]: (lib.get_score(i), i) for i in range(n) if i not in special}
        self.floor = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.raw = [b"" if i in self.control else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        self.raw[self.unknown] = " ⁇ ".encode()
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        marks_first = all(MARK not in t.lstrip(MARK) for t in self.scores)
        feeds_alone = all(t == "\n" or "\n" not in t for t in self.scores)
        feed = r"\n" if feeds_alone else ""
        self.cut = re.compile(f"{MARK}*[^{MARK}{feed}]*" + ("|\n" if feed else "")) if marks_first else re.compile(r"(?s).+")
        ranks = [lib.get_score(i) for i in range(n) if i not in special]
        # Scores of a merge model are whole numbers from 0 down; a unigram model's are logarithms.
        whole = len(set(ranks)) > 1 and all(r <= 0 and r == int(r) for r in ranks)
        self.merges = whole if merges is None else merges
        self.admitted: dict[int, bool] = {}
        self.steps: dict[str, tuple[list[float], list[str], list[str], bool]] = {}  # of pieces and single characters
        self.weights = [0.0] * n
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, (score, i) in self.scores.items():
            self.weights[i] = score
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        # Two generations: what is used again moves up, so frequent stretches stay.
        self.remembered, self.cache, self.older = remembered, {}, {}

    def _fallback(self, char: str) -> list[int]:
        codes = char.encode()
        return [self.bytes[b] for b in codes] if all(b in self.bytes for b in codes) else [self.unknown]

    def _steps(self, text: str) -> tuple[list[float], list[str], list[str], bool]:
        """The scores of the merges of a short text in order, its first and its last part
        before each and at the end, and whether one part is left."""
        told = self.steps.get(text)
        if told is None:
            parts = list(text)
            scores, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                pairs = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
                best = max((p[0] for p in pairs if p), default=None)
                if best is None:
                    break
                i = next(i for i, p in enumerate(pairs) if p and p[0] == best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            told = self.steps[text] = (scores, firsts, lasts, len(parts) == 1)
        return told

    def admits(self, before: str, piece: str) -> bool:
        """Does merging ``before + piece`` leave just these two? ``before`` is a part that merging leaves.

        Both merge by themselves, the better score first and the left one of equals, unless
        the parts at their border are a better pair at some step.
        """
        right, firsts, _, whole = self._steps(piece)
        if not before or not whole:
            return whole
        left, _, lasts, _ = self._steps(before)
        i = j = 0
        none = float("-inf")
        while True:
            across = self.scores.get(lasts[i] + firsts[j])
            a = left[i] if i < len(left) else none
            b = right[j] if j < len(right) else none
            if across and across[0] > a and across[0] >= b:
                return False
            if a == b == none:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _admits(self, key: int, before: str, piece: str) -> bool:
        if len(self.admitted) >= ADMITTED:
            self.admitted.clear()
        told = self.admitted[key] = self.admits(before, piece)
        return told

    def search_merges(self, stretch: str) -> list[int]:
        """Ids that merging a stretch of normalised text leaves."""
        n = len(stretch)
        left = [0] * (n + 1)  # the last piece up to a place, as id + 1; 0 where its last character stands alone
        known, texts, lengths = self.admitted.get, self.texts, self.lengths
        for last, i in self.automaton.iter(stretch):
            end = last + 1
            if left[end]:
                continue
            start = end - lengths[i]
            before = left[start]
            if not before and start:
                before = -ord(stretch[start - 1])
            key = before << 24 | i
            good = known(key)
            if good is None:
                text = texts[before - 1] if before > 0 else stretch[start - 1] if before else ""
                good = self._admits(key, text, texts[i])
            if good:
                left[end] = i + 1
        ids: list[int] = []
        at = n
        while at > 0:
            i = left[at] - 1
            if i >= 0:
                ids.append(i)
                at -= lengths[i]
            else:
                at -= 1
                ids += self._fallback(stretch[at])[::-1]
        ids.reverse()
        return ids

    def search(self, stretch: str) -> list[int]:
        """Ids of the way to cut a stretch of normalised text that has the best sum of scores."""
        n = len(stretch)
        best = [0.0] + [float("-inf")] * n
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        reached = 0  # places up to here have all their pieces

        def settle(end: int) -> None:
            # A character that is no piece by itself may always stand alone.
            nonlocal reached
            while reached < end:
                reached += 1
                if stretch[reached - 1] not in self.scores and best[reached - 1] + self.floor > best[reached]:
                    best[reached] = best[reached - 1] + self.floor
                    came[reached] = (reached - 1, -1)

        for last, i in self.automaton.iter(stretch):
            end = last + 1
            if end - 1 > reached:
                settle(end - 1)
            start = end - self.lengths[i]
            total = best[start] + self.weights[i]
            if total > best[end]:
                best[end] = total
                came[end] = (start, i)
        settle(n)
        ids: list[int] = []
        at = n
        while at > 0:
            start, i = came[at]
            ids += [i] if i >= 0 else self._fallback(stretch[start:at])[::-1]
            at = start
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, to which the model's front mark is added."""
        return np.frombuffer(self.packed(text), dtype=np.int32)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        parts = []
        look = self.cache.get
        for stretch in self.cut.findall(MARK + text.replace(" ", MARK)):
            ids = look(stretch)
            if ids is None:
                ids = self._found(stretch)
                look = self.cache.get
            parts.append(ids)
        return b"".join(parts)

    def _found(self, stretch: str) -> bytes:
        """Ids of a stretch that is not among the latest: from those before, or by a search."""
        ids = self.older.pop(stretch, None)
        if ids is None:
            ids = array("i", self.search_merges(stretch) if self.merges else self.search(stretch)).tobytes()
        if len(stretch) <= REMEMBERED_CHARS:
            if len(self.cache) >= self.remembered:
                self.cache, self.older = {}, self.cache
            self.cache[stretch] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text.removeprefix(" ")


_CODECS: dict[str, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec per model and worker process, so that what it remembers outlives a batch."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; tasks get it by broadcast
        return f.read()


def encoded(docs: DataFrame, model: bytes, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """Add the ids of each text; ``docs`` must not hold a column of that name."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        codec = _codec(handed.value)
        out = []
        for part in tables.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            packed = [codec.packed(t or "") for t in part.column(0).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, encode(text))


def decoded(docs: DataFrame, model: bytes, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Add the text of each list of ids; a null list gives a null text."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        codec = _codec(handed.value)
        # One list at a time: as Python numbers, a whole batch would take ten times its size.
        texts = [codec.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in column]
        return pa.array(texts, pa.string())

    return docs.withColumn(text, decode(ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    model = read_model(MODEL)
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decoded(encoded(docs, model), model)
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
