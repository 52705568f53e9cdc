"""Quality by importance resampling.

Two generative models of hashed n-grams are counted: one of the target (a bounded sample
of documents labelled good) and one of the whole raw corpus. The weight of a document is
the log ratio of its probabilities under the two, a sum over its n-grams. Gumbel noise,
made from a hash of id and text, is added to the log weight, and the documents with the k
largest sums are the sample: a draw without replacement in proportion to the weights.

k is no fixed share: it is the number of documents whose weight reaches the level that
best parts good from bad documents in a second bounded sample of labels. A larger corpus
of the same make gives a larger k, a cleaner one loses less.

n-grams are single tokens and pairs of neighbours; tokens are runs of letters and digits
(bytes from 128 count as letters) or runs of punctuation. A pair of equal tokens is one
n-gram whatever the token, as stutter is a trait of its own. Weights are whole numbers of
2^-20, so sums do not depend on the order of adding.

A null or empty text has no n-gram and weight 0. Without any label of either kind all
documents are kept. Documents of equal sums are kept or left together, so rows that repeat
share their fate and the sample may exceed k by ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables, words

NAME = "op3_quality"
ORACLE = None  # sums over hashed n-grams: checked against a plain count and held-out labels

BUCKETS = 1 << 14
#: Rows of each of the two bounded samples of labelled documents.
LABELLED_ROWS = 50_000
SEED = 17
UNIT = 1 << 20
_PAIR = np.uint64(0xD6E8FEB86659FD93)

# 0 space, 1 letter or digit, 2 punctuation
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[[*range(9, 14), 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Grams(NamedTuple):
    """Bucket of every n-gram of a run of texts, those of text i at ``bounds[i]:bounds[i + 1]``."""

    buckets: np.ndarray
    owner: np.ndarray


def grams(texts: list[bytes]) -> Grams:
    if not texts:
        return Grams(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    data, begins = words.joined(texts)
    kind = _CLASS[data]
    edges = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if len(starts) else np.empty(0, dtype=bool)
    starts, ends = starts[real], ends[real]
    hashes = words.run_hashes(data, starts, ends)
    owner = np.searchsorted(begins, starts, side="right") - 1
    together = owner[1:] == owner[:-1]
    same = hashes[1:] == hashes[:-1]
    pairs = words.mix(hashes[:-1] * _PAIR + hashes[1:])
    pairs[same] = 0
    pairs = pairs[together]
    both = np.concatenate((hashes, pairs)) % np.uint64(BUCKETS)
    return Grams(both.astype(np.int64), np.concatenate((owner, owner[:-1][together])))


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams per bucket of all rows and of those with a true ``target``: two rows of BUCKETS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in tables.slices(batch, "text"):
                chosen = np.array(part.column(1).to_pylist(), dtype=bool)
                found = grams(tables.texts(part, "text"))
                sums[0] += np.bincount(found.buckets, minlength=BUCKETS)
                sums[1] += np.bincount(found.buckets[chosen[found.owner]], minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"]
        )

    parts = docs.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[r[0]], target[r[0]] = r[1], r[2]
    return raw, target


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio per bucket in units of 2^-20; a pseudo-count of one keeps it finite."""
    if not target.sum():
        return np.zeros(len(raw), dtype=np.int64)
    p = (target + 1) / (target.sum() + len(raw))
    q = (raw + 1) / (raw.sum() + len(raw))
    return np.rint(np.log(p / q) * UNIT).astype(np.int64)


class Model(NamedTuple):
    """Log weights per bucket, the least sum with noise that is kept, and the level k comes from."""

    weights: np.ndarray
    cut: int
    level: int
    k: int


def log_weight(table: np.ndarray, spark: SparkSession):
    """A column function: the log weight of a text in units of 2^-20."""
    handed = spark.sparkContext.broadcast(table)

    @F.arrow_udf("long")
    def weigh(column: pa.Array) -> pa.Array:
        out = [np.empty(0, dtype=np.int64)]
        for part in tables.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            found = grams(tables.texts(part, "text"))
            sums = np.zeros(part.num_rows, dtype=np.int64)
            np.add.at(sums, found.owner, handed.value[found.buckets])
            out.append(sums)
        return pa.array(np.concatenate(out))

    return weigh


def gumbel() -> Column:
    """Noise of a row from its id and text, in units of 2^-20."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11)
    uniform = (bits + 0.5) / F.lit(float(1 << 53))
    return F.rint(-F.log(-F.log(uniform)) * UNIT).cast("long")


def kth_largest(values: DataFrame, name: str, k: int) -> int:
    """The kth largest of a column of longs, by ever finer counts of a thousand ranges."""
    low, high = values.agg(F.min(name), F.max(name)).first()
    while low < high:
        step = -(-(high - low + 1) // 1024)
        place = F.floor((F.col(name) - low) / step) if step > 1 else F.col(name) - low
        inside = values.filter(F.col(name).between(low, high))
        held = dict(inside.groupBy(place.alias("p")).count().collect())
        for p in sorted(held, reverse=True):
            if k <= held[p]:
                low, high = low + p * step, min(high, low + (p + 1) * step - 1)
                break
            k -= held[p]
    return low


def best_level(scores: np.ndarray, good: np.ndarray) -> int:
    """The weight that best parts good from bad, in the middle of its gap; both kinds count alike."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    bad_below = np.concatenate(([0], np.cumsum(~good))) / max(1, (~good).sum())
    good_below = np.concatenate(([0], np.cumsum(good))) / max(1, good.sum())
    gain = bad_below - good_below
    gain[1:-1][scores[1:] == scores[:-1]] = -1  # no cut inside a tie
    at = int(gain.argmax())
    if at == 0:
        return int(scores[0])
    return int(scores[-1]) + 1 if at == len(scores) else int(scores[at - 1] + scores[at] + 1) // 2


def _sampled(labels: DataFrame, part: int) -> DataFrame:
    """One of two disjoint samples of about LABELLED_ROWS labels, by a hash of the id."""
    n = max(1, labels.count())
    share = min(0.5, LABELLED_ROWS / n)
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    return labels.filter(place.between(0.5 * part, 0.5 * part + share))


def _labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)`` once per id; toxic documents are no part of the target."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"),
             F.max((F.col("quality") == 0)).alias("bad"))
    )


def weighed(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Log weight and noisy sum of every document, and the model they come from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    told = tables.kept(_labels(labels), "quality-labels")
    # At most LABELLED_ROWS or so ids, whatever the number of labels.
    chosen = F.broadcast(_sampled(told, 0).filter("good").select("doc_id", F.lit(True).alias("target")))
    marked = docs.join(chosen, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    table = weights(*counts(marked))
    weight = log_weight(table, spark)
    scored = tables.kept(
        docs.select("doc_id", weight("text").alias("weight"), gumbel().alias("noise")).select(
            "doc_id", "weight", (F.col("weight") + F.col("noise")).alias("noisy")
        ),
        "quality-weights",
    )
    tried = F.broadcast(_sampled(told, 1).filter("good or bad").select("doc_id", "good"))
    rows = scored.join(tried, "doc_id").select("weight", "good").collect()  # of the second sample
    sides = {r["good"] for r in rows}
    n = scored.count()
    if len(sides) == 2 and n:
        level = best_level(np.array([r["weight"] for r in rows]), np.array([r["good"] for r in rows]))
        k = scored.filter(F.col("weight") >= level).count()
    else:
        level, k = np.iinfo(np.int64).min, n
    cut = kth_largest(scored, "noisy", k) if 0 < k < n else (np.iinfo(np.int64).min if k else np.iinfo(np.int64).max)
    return scored, Model(table, int(cut), int(level), k)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of the sample with all their columns; no row is shuffled for it."""
    _, model = weighed(docs, labels)
    weight = log_weight(model.weights, docs.sparkSession)
    return docs.filter(weight("text") + gumbel() >= model.cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    scored, model = weighed(docs, labels)
    return scored.select(
        "doc_id",
        (F.col("weight") / UNIT).alias("log_weight"),
        (F.col("noisy") / UNIT).alias("noisy_weight"),
        (F.col("noisy") >= model.cut).alias("kept"),
    )
