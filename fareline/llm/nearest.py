"""Exact top-k by inner product: branch and bound over ball trees.

Candidates lie in shards of a bounded number of rows by a hash of their id; each shard has
a ball tree. For a query q and a ball with centre c and radius r no inner product exceeds
q.c + |q| r; a search enters the better child first and leaves out balls below the query's
kth score so far. The kth scores are shared between shards: a first wave of shards gives
each query a kth score that the second wave starts from.

Queries go out in blocks of a fixed number of rows, each block against all shards, so
neither a broadcast nor a task grows with the table. Ties go to the smaller id. Vectors
that are null or hold null or non-finite components take no part; shorter vectors count
as padded with zeros. Rows with a null id are left out. Rows that share an id are all
candidates, but none of them for a query of that id; queries that share an id are one query,
whose answer is the best of all their scores (a candidate once for each of them).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op10_nearest"
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 20
"""

SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 128
#: Share of the shards that give the first kth scores.
FIRST_WAVE = 8
LOWEST = np.iinfo(np.int64).min


class Ball(NamedTuple):
    """Rows ``start:stop`` of the shard's order; leaves have no children."""

    start: int
    stop: int
    centre: np.ndarray
    radius: float
    children: tuple


class Shard:
    """A ball tree over whole-number vectors, rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.arange(len(ids))
        self.root = self._ball(0, len(ids))
        self.dealt = self.vectors[self.order]

    def _ball(self, start: int, stop: int) -> Ball:
        points = self.vectors[self.order[start:stop]].astype(np.float64)
        centre = points.mean(axis=0)
        away = np.linalg.norm(points - centre, axis=1)
        radius = float(away.max())
        if stop - start <= LEAF_ROWS or radius == 0:
            return Ball(start, stop, centre, radius, ())
        one = points[away.argmax()]
        other = points[np.linalg.norm(points - one, axis=1).argmax()]
        side = points @ (other - one)
        half = len(side) // 2
        self.order[start:stop] = self.order[start:stop][np.argpartition(side, half)]
        return Ball(start, stop, centre, radius, (self._ball(start, start + half), self._ball(start + half, stop)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best k per query; row -1 where there are fewer.

        ``least``: a score k candidates are known to reach. Lower scores are left out.
        """
        n = len(self.ids)
        top = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(self.vectors).max(initial=0)))
        # Doubles hold the scores exactly up to 2^53; whole numbers of any size do beyond.
        kind = np.float64 if top * queries.shape[1] * n < 2**53 else object
        dealt, asked = self.dealt.astype(kind).T, queries.astype(kind)
        whole_kind = np.int64 if kind is np.float64 else object
        # Larger keys are better: the score, then the smaller id.
        keys = np.full((len(queries), k), LOWEST, dtype=whole_kind)
        floor = least.copy()
        own_from, own_to = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
        real = queries.astype(np.float64)
        length = np.linalg.norm(real, axis=1)

        def bound(ball: Ball, who: np.ndarray) -> np.ndarray:
            most = real[who] @ ball.centre + length[who] * ball.radius
            return most + 1e-6 * (1 + np.abs(most))

        def visit(ball: Ball, who: np.ndarray, most: np.ndarray) -> None:
            who = who[most >= floor[who]]
            if not len(who):
                return
            if ball.children:
                left, right = ball.children
                to_left, to_right = bound(left, who), bound(right, who)
                first = to_left >= to_right
                visit(left, who[first], to_left[first])
                visit(right, who, to_right)
                visit(left, who[~first], to_left[~first])
                return
            rows = self.order[ball.start : ball.stop]
            scores = (asked[who] @ dealt[:, ball.start : ball.stop]).astype(whole_kind)
            fresh = scores * n + (n - 1 - rows)
            fresh[(own_from[who][:, None] <= rows) & (rows < own_to[who][:, None])] = LOWEST
            both = np.concatenate([keys[who], fresh], axis=1)
            keys[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            worst = keys[who].min(axis=1)
            full = worst > LOWEST
            floor[who[full]] = np.maximum(floor[who[full]], (worst[full] // n).astype(np.int64))

        everyone = np.arange(len(queries))
        visit(self.root, everyone, bound(self.root, everyone))
        found = keys > LOWEST
        rows = np.where(found, n - 1 - keys % n, -1).astype(np.int64)
        return rows, np.where(found, keys // n, 0).astype(np.int64)


def whole(embeddings: DataFrame, id_name: str, vector: str) -> DataFrame:
    """``(id, v)`` with components floor(64 x), of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.filter(F.col(id_name).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(id_name).cast("long").alias("id"), F.transform(x, lambda c: F.floor(64 * c)).alias("v")
    )


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


_FOUND = "query_id long, vec_id long, score long"


def _searched(shards: DataFrame, block: tuple, k: int, width: int) -> DataFrame:
    """The best k of each shard for a block of queries, as far as they can matter."""
    handed = shards.sparkSession.sparkContext.broadcast(block)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, queries, least = handed.value
        shard = Shard(rows["id"].to_numpy(), _matrix(rows["v"], width))
        at, scores = shard.search(ids, queries, k, least)
        good = (at >= 0) & (scores >= least[:, None])
        return pd.DataFrame(
            {"query_id": np.repeat(ids, good.sum(axis=1)), "vec_id": shard.ids[at[good]], "score": scores[good]}
        )

    return shards.groupBy("shard").applyInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each query the k largest inner products among all other vectors.

    Both frames hold ``(id, v)`` as :func:`whole` gives them.
    """
    vectors = tables.kept(vectors, "nearest-vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    first = max(1, shards // FIRST_WAVE)
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    queries = tables.kept(queries, "nearest-queries")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    in_block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = queries.filter(in_block == b).orderBy("id").collect()  # about QUERY_ROWS
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        asked = _matrix([r["v"] for r in rows], width)
        none = np.full(len(ids), LOWEST)
        one = tables.kept(_searched(placed.filter(F.col("shard") < first), (ids, asked, none), k, width), "nearest-first")
        kth = {r["query_id"]: r["score"] for r in _best(one, k).filter(F.col("rank") == k).collect()}
        least = np.array([kth.get(i, LOWEST) for i in ids.tolist()], dtype=np.int64)
        rest = _searched(placed.filter(F.col("shard") >= first), (ids, asked, least), k, width)
        best = tables.kept(_best(one.unionByName(rest), k), "nearest-found")
        out = best if out is None else out.unionByName(best)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")
