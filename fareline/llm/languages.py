"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 made from its code point. A letter n-gram is
the element-wise product (binding) of its letters' vectors, each rotated by its place. A
text is the sum (bundle) of its n-grams, a language the sum of its training texts, and a
text gets the language whose prototype has the largest cosine with it.

Texts are lower-cased, runs of anything but letters (Unicode's letter categories, with the
marks that combine with them) count as one space, and a space is set at either end, so one
letter is enough for an n-gram. Numerals of any kind are no letters. A text without a letter, or null, is
``und`` with score 0, as is every text if there is nothing to learn from. Equal cosines go
to the language that sorts first. The score is the cosine moved to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op7_languages"
ORACLE = None  # cosines of random vectors: checked against brute force and held-out accuracy

DIMENSIONS = 512
GRAM = 3
#: Rows of the largest bounded sample that prototypes are fitted on, chosen by a hash of id and text.
TRAIN_ROWS = 40_000
#: Letters handled at once; a longer text is summed in pieces, which changes nothing.
PIECE = 1 << 20
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters and single spaces; empty if there is no letter."""
    spaced = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not _LETTER.search(spaced):
        return np.empty(0, dtype=np.uint32)
    return np.frombuffer(f" {spaced} ".encode("utf-32-le"), dtype=np.uint32)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, one row of code points each, and how often each occurs."""
    code = np.zeros(max(0, len(points) - GRAM + 1), dtype=np.int64)
    for j in range(GRAM):
        code = code << 21 | points[j : len(points) - GRAM + 1 + j]
    found, times = np.unique(code, return_counts=True)
    return found, times


class Letters:
    """Vectors of n-grams, made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self._letter: dict[int, np.ndarray] = {}
        self._place: dict[int, int] = {}
        self._grams = np.empty((0, dimensions), dtype=np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self._letter:
            bits = np.random.Generator(np.random.PCG64([7, point])).integers(0, 2, self.dimensions)
            self._letter[point] = (2 * bits - 1).astype(np.float32)
        return self._letter[point]

    def gram(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.float32)
        for j in range(GRAM):
            point = code >> 21 * (GRAM - 1 - j) & (1 << 21) - 1
            out *= np.roll(self.letter(point), GRAM - 1 - j)
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        places = [self._place.get(c, -1) for c in codes.tolist()]
        fresh = [c for c, p in zip(codes.tolist(), places, strict=True) if p < 0]
        if fresh:
            if len(self._place) + len(fresh) > 50_000:  # forget rather than grow
                self._place, self._grams = {}, self._grams[:0]
                return self.rows_of(codes)
            start = len(self._place)
            self._place.update((c, start + i) for i, c in enumerate(fresh))
            if start + len(fresh) > len(self._grams):
                room = np.empty((2 * (start + len(fresh)), self.dimensions), dtype=np.float32)
                room[:start] = self._grams[:start]
                self._grams = room
            for i, c in enumerate(fresh):
                self._grams[start + i] = self.gram(c)
            places = [self._place[c] for c in codes.tolist()]
        return self._grams[places]

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([self.gram(c) for c in codes.tolist()])

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of a text's n-gram vectors, or None without a letter."""
        points = letters(text)
        if not len(points):
            return None
        total = np.zeros(self.dimensions, dtype=np.float64)
        for start in range(0, len(points) - GRAM + 1, PIECE):
            codes, times = counted(points[start : start + PIECE + GRAM - 1])
            for at in range(0, len(codes), 4096):
                total += times[at : at + 4096].astype(np.float32) @ self.rows(codes[at : at + 4096])
        return total


def sampled(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` rows by a hash of id and text; all of them where there are no more."""
    share = min(1.0, rows / max(1, docs.count()))
    if share == 1.0:
        return docs
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    return docs.filter(place < share)


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One vector per language of ``train(text, lang)``: as many rows as there are languages.

    Each task adds up its own texts; what is shuffled is a vector per task and language.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Letters(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                vector = space.bundle(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector
        yield pd.DataFrame(
            [(lang, v.tolist()) for lang, v in sums.items()], columns=["lang", "vector"]
        )

    parts = train.select("text", "lang").mapInPandas(add_up, "lang string, vector array<double>")
    summed = (
        parts.select("lang", F.posexplode("vector").alias("i", "x"))
        .groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("lang", "v.x")
    )
    return {r["lang"]: np.array(r["x"]) for r in summed.toLocalIterator()}


def with_language(
    docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", name: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """Add the predicted language and its score; ``docs`` must not hold columns of these names."""
    names = sorted(k for k, v in learned.items() if np.any(v))
    known = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else None
    handed = docs.sparkSession.sparkContext.broadcast((names, known))
    space: list[Letters] = []

    @F.arrow_udf(f"struct<{name}:string,{score}:double>")
    def predict(column: pa.Array) -> pa.Array:
        names, known = handed.value
        if not space:
            space.append(Letters(known.shape[1] if names else DIMENSIONS))
        langs, scores = [], []
        for t in column.to_pylist():
            vector = space[0].bundle(t) if names else None
            size = 0.0 if vector is None else float(np.linalg.norm(vector))
            if not size:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosines = known @ (vector / size)
            best = int(np.argmax(cosines))
            langs.append(names[best])
            scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [name, score])

    told = tables.unused(docs, "_language")
    return docs.withColumn(told, predict(F.col(text))).select(*docs.columns, f"{told}.{name}", f"{told}.{score}")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    learned = prototypes(sampled(train))
    return with_language(docs.select("doc_id", "text"), learned).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
