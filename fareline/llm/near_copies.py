"""Near copies by Order MinHash, verified by banded alignment.

Shingles are five words in a row (all words of a shorter text). Two texts are similar when
shingles aligned in order / (shingles of both - aligned) is 0.8 or more; without moved
blocks this is their Jaccard similarity, and a moved block counts as changed.

1. Texts with the same words are one text, named by its smallest id.
2. Order MinHash: each of ``SKETCHES`` sketches takes the ``KEPT`` occurrence-labelled
   shingles with the smallest hashes and hashes them in text order. Texts that share a
   sketch are candidates. At similarity 0.8 a sketch agrees with a chance of about one
   half, and all of them differ in about 1 of 20,000 pairs.
3. In each bucket every text is compared with the bucket's hub, the text that shares most
   sketches with others, so a bucket costs as many comparisons as it has texts.
4. Two texts of a bucket that are still in different classes need
   ``SIMILARITY / (1 + SIMILARITY)`` of their shingles in common. The hub's share of these is
   at most what the smaller overlap with the hub gives, so they have a shingle in common
   that the hub lacks, or are both so close to the hub that this does not follow. An exact
   join by hub and rare shingles outside it finds the former, a join by hub on that
   condition the few of the latter. A passage or an origin that a whole bucket shares is in
   the hub, so large buckets yield no pairs for it, and no link is lost.
5. Classes are the connected components of the verified links.

Texts without words, null ones too, are one class. Rows with a null id have no class and
stay. Rows that repeat are members of their class like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables, words

NAME = "op4_near_copies"
ORACLE = None  # sketches and alignment: checked against all pairs on a small table

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 14
KEPT = 3

_random = np.random.default_rng(404)
_SKETCH = _random.integers(1, 2**63, (SKETCHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _random.integers(1, 2**63, KEPT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OCCURRENCE = np.uint64(0xA0761D6478BD642F)


def shingles(text: bytes) -> np.ndarray:
    hashes = words.split([text]).hashes
    return words.grams(hashes, min(SHINGLE, len(hashes))) if len(hashes) else hashes


def labelled(found: np.ndarray) -> np.ndarray:
    """Shingle hashes made different for each occurrence of the same shingle."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return words.mix(found)
    places = np.arange(len(found))
    times = np.empty(len(found), dtype=np.uint64)
    times[order] = places - np.maximum.accumulate(np.where(new, places, 0))
    return words.mix(found + times * _OCCURRENCE)


def sketches(found: np.ndarray) -> np.ndarray:
    """One hash per sketch, different between sketches."""
    own = labelled(found)
    chosen = np.empty((SKETCHES, min(KEPT, len(own))), dtype=np.int64)
    step = max(1, (1 << 20) // max(1, len(own)))
    for j in range(0, SKETCHES, step):
        values = own * _SKETCH[j : j + step]
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(32)
        kept = chosen.shape[1]
        chosen[j : j + step] = np.argpartition(values, kept - 1, axis=1)[:, :kept] if kept < len(own) else np.arange(kept)
    in_order = found[np.sort(chosen, axis=1)]
    total = (in_order * _ORDER[: in_order.shape[1]]).sum(axis=1, dtype=np.uint64)
    return words.signed(words.mix(total ^ _SKETCH[:, 0]))


# ---- similarity ---------------------------------------------------------------


def _needed(n: int) -> int:
    """Shingles that texts of ``n`` shingles together must have aligned."""
    return int(np.ceil(SIMILARITY * n / (1 + SIMILARITY) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Longest common subsequence if it has ``need`` elements or more, else something smaller.

    Equal ends are taken off; the rest is aligned within the band that ``need`` leaves, a
    step per element of ``b`` on the bits of the band.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done, rest = head + tail, need - head - tail
    above, below = len(a) - rest, len(b) - rest  # how far the path may leave the diagonal
    if not len(a) or not len(b) or min(above, below) < 0:
        return done
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    below, above = min(below, len(b)), min(above, len(a))
    low = high = found = window = 0  # bits low to high of the rows; a zero is a step of the alignment
    for j, x in enumerate(b.tolist()):
        top = min(len(a), j + above + 1)
        window |= ((1 << top - high) - 1) << high - low
        high = top
        if j - below > low:  # the lowest row leaves the band
            found += not window & 1
            window >>= 1
            low += 1
        hit = places.get(x, 0) >> low & window
        if hit:
            window = (window + hit | window - hit) & (1 << high - low) - 1
    return done + found + (high - low - window.bit_count()) if high == len(a) else done


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned shingles over all, or 0 where it is below the needed similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    need = _needed(len(a) + len(b))
    if min(len(a), len(b)) < need:
        return 0.0
    same = np.intersect1d(labelled(a), labelled(b), assume_unique=True).size
    if same < need:
        return 0.0
    common = aligned(a, b, need)
    return common / (len(a) + len(b) - common) if common >= need else 0.0


# ---- Spark --------------------------------------------------------------------


def _sketched(docs: DataFrame) -> DataFrame:
    """Id, row key, digest of the words, and sketches of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.slices(batch, "text"):
                raw = tables.texts(part, "text")
                digests = [hashlib.sha256(b" ".join(t.split())).digest() for t in raw]
                found = words.split(raw)
                runs = words.grams(found.hashes, SHINGLE)
                out = []
                for start, stop in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
                    n = stop - start
                    own = runs[start : stop - SHINGLE + 1] if n >= SHINGLE else words.grams(found.hashes[start:stop], n)
                    out.append(sketches(own) if n else np.empty(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                    ["doc_id", "row_key", "digest", "sketches"],
                )

    return docs.select("doc_id", "text", "row_key").mapInArrow(
        run, "doc_id long, row_key long, digest binary, sketches array<long>"
    )


def _with_texts(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    first = contents.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = contents.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``; ``contents(id, text)`` has a row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                similarity(shingles(one.encode()), shingles(other.encode())) >= SIMILARITY
                for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return tables.kept(_with_texts(pairs, contents).mapInArrow(run, "a long, b long"), "near-links")


_STAR = "a long, b long, similar boolean, n long, common long, fresh array<long>"


def _compared(stars: DataFrame, contents: DataFrame) -> DataFrame:
    """Each text ``a`` of ``stars(a, b)`` beside its hub ``b``: whether they are similar, the
    shingles of ``a``, how many of them the hub has, and those that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray, np.ndarray] = (None, np.empty(0), np.empty(0))
        for batch in batches:
            for part in tables.slices(batch, "text_a"):
                rows = []
                for hub, one, other in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if last[0] != hub:
                        found = shingles(other.encode())
                        last = (hub, found, labelled(found))
                    own = shingles(one.encode())
                    fresh = np.setdiff1d(labelled(own), last[2], assume_unique=True)
                    rows.append((similarity(own, last[1]) >= SIMILARITY, len(own), len(own) - len(fresh), words.signed(fresh)))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                    ["a", "b", "similar", "n", "common", "fresh"],
                )

    return tables.kept(_with_texts(stars, contents).mapInArrow(run, _STAR), "near-stars")


def components(links: DataFrame) -> DataFrame:
    """``(id, class_id)`` of every id in ``links(a, b)``; a class is named by its smallest id.

    Each round hands the smallest name on to neighbours and then to those that bear a
    renamed one's name, so the rounds grow with the logarithm of the longest chain.
    """
    both = tables.kept(links.union(links.select("b", "a")).toDF("id", "near").distinct(), "near-edges")
    names = tables.kept(both.select("id", F.col("id").alias("name")).distinct(), "near-names")
    while True:
        told = both.join(names.toDF("near", "near_name"), "near").groupBy("id").agg(F.min("near_name").alias("least"))
        hooked = tables.kept(
            names.join(told, "id").select("id", "name", F.least("name", "least").alias("new")), "near-hooked"
        )
        above = hooked.select(F.col("id").alias("new"), F.col("new").alias("above"))
        jumped = hooked.join(above, "new").select("id", F.least("new", "above").alias("new"), "name")
        after = tables.kept(jumped.select("id", F.col("new").alias("name"), (F.col("new") != F.col("name")).alias("moved")), "near-names")
        names = after.select("id", "name")
        if after.filter("moved").isEmpty():
            return names.toDF("id", "class_id")


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the class of ``id``, itself where it has no link."""
    return rows.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def _stars(members: DataFrame) -> DataFrame:
    """Each text ``a`` of ``members(bucket, id)`` with the hubs ``b`` of its buckets."""
    # Stored, as a join right above an aggregation is not cut at a hot bucket.
    sizes = tables.kept(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    fame = members.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("fame"))
    famous = F.struct("fame", -F.col("id"))
    hubs = tables.kept(
        members.join(tables.kept(fame, "near-fame"), "id").groupBy("bucket").agg(F.max_by("id", famous).alias("b")), "near-hubs"
    )
    return members.join(hubs, "bucket").filter("id != b").select(F.col("id").alias("a"), "b").distinct()


def _other_pairs(compared: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts beside the same hub and of different classes that can be similar."""
    placed = _with_class(compared.withColumnRenamed("a", "id"), classes).drop("similar")
    several = placed.groupBy("b").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).filter("x != y")
    # Two texts whose nearest hub is the same need be met beside that hub alone.
    nearest = placed.groupBy("id").agg(F.max_by("b", F.struct("common", "b")).alias("nearest"))
    open_ones = tables.kept(
        placed.join(several.select("b"), "b", "left_semi").join(tables.kept(nearest, "near-nearest"), "id"), "near-open"
    )
    share = SIMILARITY / (1 + SIMILARITY)

    every = open_ones.select("b", "id", "class_id", "n", F.explode("fresh").alias("shingle"))
    often = tables.kept(
        every.groupBy("b", "shingle")
        .agg(F.count(F.lit(1)).alias("often"), F.min("class_id").alias("x"), F.max("class_id").alias("y"))
        .filter("often > 1"),
        "near-often",
    )
    # Rarest first among the shingles that the hub lacks, as many as a text may be without
    # and one more: two similar texts have their first common shingle among these.
    told = every.join(often, ["b", "shingle"])
    lone = F.size("fresh") - F.size("s")  # in no other text of the hub, so rarer than all others
    length = F.greatest(F.lit(0), (F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n") - 1e-9) + 1).cast("int") - lone)
    mixed = F.struct("often", "shingle", (F.col("x") != F.col("y")).alias("mixed"))
    listed = told.groupBy("b", "id").agg(F.sort_array(F.collect_list(mixed)).alias("s"))
    prefix = F.transform(
        F.filter(F.slice("s", F.lit(1), length), lambda x: x["mixed"]), lambda x: x["shingle"]
    )
    keyed = tables.kept(
        open_ones.join(listed, ["b", "id"])
        .select("b", "id", "class_id", "n", "nearest", "common", prefix.alias("prefix"), F.col("s.shingle").alias("repeated"))
        .select("*", F.explode("prefix").alias("shingle")),
        "near-prefixes",
    )
    apart = (
        (F.col("id") < F.col("id2"))
        & (F.col("class_id") != F.col("class2"))
        & (F.least("n", "n2") >= F.lit(SIMILARITY) * F.greatest("n", "n2") - 1e-9)
        & ((F.col("nearest") != F.col("nearest2")) | (F.col("nearest") == F.col("b")))
    )
    renamed = keyed.select(
        "b", "shingle", F.col("id").alias("id2"), F.col("class_id").alias("class2"), F.col("n").alias("n2"),
        F.col("nearest").alias("nearest2"), F.col("common").alias("common2"), F.col("prefix").alias("prefix2"),
        F.col("repeated").alias("repeated2"),
    )
    # What similar texts share beyond the hub: at least what they need without the hub's part.
    beyond = F.size(F.array_intersect("repeated", "repeated2"))
    enough = beyond >= share * (F.col("n") + F.col("n2")) - F.least("common", "common2") - 1e-6
    once = F.array_min(F.array_intersect("prefix", "prefix2")) == F.col("shingle")
    met = keyed.join(renamed, ["b", "shingle"]).filter(apart & once & enough)

    # So much in common with the hub that nothing else need be shared. A text is let in by
    # what it needs beside the shortest text of its hub, which leaves few.
    shortest = open_ones.groupBy("b").agg(F.min("n").alias("least_n"))
    slim = open_ones.select("b", "id", "class_id", "n", "nearest", "common")
    close = tables.kept(
        slim.join(shortest, "b").filter(F.col("common") > share * (F.col("n") + F.col("least_n")) - 1).drop("least_n"), "near-close"
    )
    beside = close.join(close.toDF("b", "id2", "class2", "n2", "nearest2", "common2"), "b").filter(
        apart & (F.least("common", "common2") > share * (F.col("n") + F.col("n2")) - 1)
    )
    return met.select("id", "id2").union(beside.select("id", "id2")).toDF("a", "b").distinct()


def find_near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, text_id, class_id, class_key)`` per row: its text and class by smallest ids.

    ``row_key`` is ``xxhash64`` of the text and ``class_key`` a hash of the class, to tell
    apart rows and classes that share an id.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key")
    )
    seen = tables.kept(_sketched(rows), "near-sketches")
    names = tables.kept(seen.groupBy("digest").agg(F.min("doc_id").alias("id")), "near-texts")
    # One row per text carries its sketches on; ids that name several texts are told apart by digest.
    one = seen.join(names.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"]).groupBy("digest", "doc_id").agg(
        F.first("sketches").alias("sketches"), F.min("row_key").alias("row_key")
    )
    texts = tables.kept(one.select("*", F.xxhash64("digest").alias("id")), "near-one")
    spread = texts.select("id", F.explode("sketches").alias("bucket"))
    shared = tables.kept(spread.groupBy("bucket").count().filter("count > 1").select("bucket"), "near-shared")
    members = tables.kept(spread.join(shared, "bucket", "left_semi"), "near-members")
    asked = members.select("id").distinct().join(texts.select("id", "doc_id", "row_key"), "id")
    contents = tables.kept(
        rows.join(asked, ["doc_id", "row_key"]).groupBy("id").agg(F.first("text").alias("text")), "near-contents"
    )
    compared = _compared(_stars(members), contents)
    links = compared.filter("similar").select("a", "b")
    more = _verified(_other_pairs(compared, components(links)), contents)
    classes = components(links.union(more))
    # From hashes of texts back to the smallest ids.
    named = _with_class(texts.select("id", "digest", "doc_id"), classes)
    least = named.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    of_text = tables.kept(
        named.join(least, "class_id").select(
            "digest", F.col("doc_id").alias("text_id"), F.col("least").alias("class_id"), F.col("class_id").alias("class_key")
        ),
        "near-classes",
    )
    return seen.select("doc_id", "row_key", "digest").join(of_text, "digest").select(
        "doc_id", "row_key", "text_id", "class_id", "class_key"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest id, and all rows without an id."""
    classes = find_near_copies(docs).filter("doc_id = class_id")
    stay = classes.groupBy("class_key").agg(F.first("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"))
    stay = tables.kept(stay.select("doc_id", "row_key"), "near-stay")
    key, best_id, best_key = (tables.unused(docs, n) for n in ("_key", "_best_id", "_best_key"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    best = keyed.join(
        stay.toDF(best_id, best_key), (F.col("doc_id") == F.col(best_id)) & (F.col(key) == F.col(best_key)), "left_semi"
    ).dropDuplicates(["doc_id", key])
    return best.unionByName(keyed.filter(F.col("doc_id").isNull())).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    known = find_near_copies(docs).select("doc_id", "text_id", "class_id")
    without_id = docs.filter(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_id"), F.lit(None).cast("long").alias("class_id")
    )
    return known.unionByName(without_id).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
