"""The trie of the turns that conversations begin with, and what shared prefixes save.

Turns are encoded by a dictionary: every different (role, text) has a number. Conversations,
as arrays of numbers in order, are dealt to ranges and sorted, so the conversations below a
node of the trie lie side by side. A range is read in shards of at most ``SHARD_TURNS`` turns
(one conversation at least); each shard is a ternary search tree, balanced by inserting the
median of the sorted sequences first and then those of either half. One traversal without
recursion, in the order of insertion and back, sums members, leaves and savings.

A node is a boundary node of a shard if the first or the last sequence of the shard begins
with it: only such a node can have members in other shards. All others are final. Of boundary
nodes a shard gives its two paths, with what hangs below them inside the shard; they are
merged by the digest of their turns. One row of each merged node then stands for it, and sums
along the paths carry leaves and savings up, each node counted once. These rows are two paths
a shard, whatever the shards hold.

Ids of conversations that end at a boundary node come as runs of text, which one reader of the
node's runs, in order, passes through the hash; it keeps none of them.

Turns come in the order of ``turn``, null first; equal turns in the order of their digest; rows
that repeat are turns of their own. Null roles and texts are empty, and so is a turn of both.
Rows without a conversation id belong to no conversation. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareline.llm import tables

NAME = "op11_prefix_trie"
ORACLE = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS turns FROM t GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, v: CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384) ELSE xor(c, v) >> 1 END),
         4294967295) % 4 AS h
  FROM own
),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS s
  FROM crc o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
),
members AS (
  SELECT conv_id, len(s) AS n, s, list_transform(s, lambda x: x.k) AS ks, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt
),
nodes AS (
  SELECT ks[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256,
         coalesce(any_value(s[depth].w), 0) AS w
  FROM members GROUP BY 1, 2
),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (p)),
up AS (
  SELECT p[1:above] AS p, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * w) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN up u USING (p) LEFT JOIN nodes q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
"""

SHARD_TURNS = 65_536
#: Conversations whose id is no multiple of this begin with turns of the one that is.
FAMILY = 20
HEADS = 4
#: Ids in one run of text.
RUN_IDS = 4096
NODE, EDGE, ENDS = 0, 1, 2
_ROOT = hashlib.sha256().digest()


# ---- sequences of dictionary numbers -----------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, words)`` of every row that has a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def dictionary(turns: DataFrame) -> DataFrame:
    """``(digest, id)``, a number for every different turn."""
    return tables.kept(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, ids, words)``: the turns of each conversation in order, as they are."""
    rows = tables.kept(turns(conversations), "trie-turns")
    coded = rows.join(dictionary(rows), "digest")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words")))
    return coded.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")
    )


def rebuilt(own: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Conversations that begin with the first turns of the one whose id is the multiple of ``family``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    own = tables.kept(own, "trie-own")
    first = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "words")]
    )

    def joined(c: str):
        head = F.coalesce(F.col(f"head_{c}"), F.array().cast("array<long>"))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)

    return own.withColumns({"h": h, "base": base}).join(first, "base", "left").select("conv_id", joined("ids"), joined("words"))


# ---- one shard ----------------------------------------------------------------


class TernaryTree:
    """Nodes in order of insertion; 0 is the root, -1 stands for no node.

    ``low`` and ``high`` lead to other turns after the same prefix, ``same`` to the turns
    that follow this one.
    """

    def __init__(self) -> None:
        self.turn, self.low, self.same, self.high, self.words = [-1], [-1], [-1], [-1], [0]

    def _new(self, links: list[int], at: int, turn: int, words: int) -> int:
        links[at] = node = len(self.turn)
        self.turn.append(turn)
        self.words.append(words)
        for other in (self.low, self.same, self.high):
            other.append(-1)
        return node

    def insert(self, turns: list[int], words: list[int]) -> int:
        """The node of the whole sequence."""
        at = 0
        for turn, n in zip(turns, words, strict=True):
            node = self.same[at]
            if node < 0:
                at = self._new(self.same, at, turn, n)
                continue
            while self.turn[node] != turn:
                links = self.low if turn < self.turn[node] else self.high
                if links[node] < 0:
                    node = self._new(links, node, turn, n)
                else:
                    node = links[node]
            at = node
        return at

    def path(self, turns: list[int]) -> list[int]:
        """The nodes from the root to the end of a sequence that was inserted."""
        out = [0]
        for turn in turns:
            node = self.same[out[-1]]
            while self.turn[node] != turn:
                node = self.low[node] if turn < self.turn[node] else self.high[node]
            out.append(node)
        return out

    def traverse(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes with parents first; parent and depth of each node."""
        parent, depth, order = [-1] * len(self.turn), [0] * len(self.turn), []
        stack = [0]
        while stack:
            node = stack.pop()
            order.append(node)
            for other in (self.low[node], self.high[node]):
                if other >= 0:
                    parent[other], depth[other] = parent[node], depth[node]
                    stack.append(other)
            below = self.same[node]
            if below >= 0:
                parent[below], depth[below] = node, depth[node] + 1
                stack.append(below)
        return order, parent, depth


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of either half."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(middle + 1, high), (low, middle)]


def _ends_text(ids: list[int]) -> str:
    return ",".join(map(str, ids))


COLUMNS = {
    "kind": pa.int32(),
    "shard": pa.int64(),
    "side": pa.int32(),
    "key": pa.binary(),
    "parent_key": pa.binary(),
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "words": pa.int64(),
    "ends": pa.string(),
}
_SCHEMA = ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[t]}" for n, t in COLUMNS.items())


def shard_rows(shard: int, convs: list[int], ids: list[list[int]], words: list[list[int]]) -> list[tuple]:
    """The rows of one shard in the order of ``COLUMNS``, from conversations sorted by (ids, conv).

    Final nodes have their digest in ``ends``. Of boundary nodes the numbers leave out what
    other boundary nodes add, and a node on both paths has them on the first alone.
    """
    tree = TernaryTree()
    starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    stops = [*starts[1:], len(ids)]
    members: dict[int, list[int]] = {}
    for k in medians(len(starts)):
        node = tree.insert(ids[starts[k]], words[starts[k]])
        members[node] = convs[starts[k] : stops[k]]
    order, parent, depth = tree.traverse()
    n = len(order)
    n_convs, n_children, n_leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n
    smallest: list[int | None] = [None] * n
    paths = [tree.path(ids[0]), tree.path(ids[-1])]
    boundary = set(paths[0]) | set(paths[1])
    for node in reversed(order):
        mine = members.get(node, [])
        n_convs[node] += len(mine)
        if mine and (smallest[node] is None or mine[0] < smallest[node]):
            smallest[node] = mine[0]
        up = parent[node]
        if node not in boundary:
            n_leaves[node] += n_children[node] == 0
            saved[node] += (n_convs[node] - 1) * tree.words[node]
            n_children[up] += 1
            n_leaves[up] += n_leaves[node]
            saved[up] += saved[node]
        if up >= 0:
            n_convs[up] += n_convs[node]
            if smallest[up] is None or smallest[node] < smallest[up]:
                smallest[up] = smallest[node]

    keys: dict[int, bytes] = {}
    edges, ends = [], []
    for side, path in enumerate(paths):
        running = hashlib.sha256()
        key = None
        for node in path:
            if node:
                running.update(tree.turn[node].to_bytes(8, "little"))
            before, key = key, running.digest()
            seen = node in keys
            keys[node] = key
            numbers = (n_convs[node], n_children[node], n_leaves[node], saved[node])
            edges.append(
                (EDGE, shard, side, key, before, None if seen else smallest[node], depth[node], None)
                + ((0, 0, 0, 0) if seen else numbers)
                + (tree.words[node], None)
            )
            if not seen and node in members:
                mine = members[node]
                for i in range(0, len(mine), RUN_IDS):
                    run = mine[i : i + RUN_IDS]
                    ends.append((ENDS, shard, side, key, None, run[0], *[None] * 7, _ends_text(run)))
    nodes = []
    for node in order:
        if node not in boundary:
            up = parent[node]
            open_parent = up in boundary
            digest = hashlib.sha256(_ends_text(members.get(node, [])).encode()).hexdigest()
            nodes.append(
                (NODE, shard, None, None, keys[up] if open_parent else None, smallest[node], depth[node])
                + (None if open_parent else smallest[up], n_convs[node], n_children[node], n_leaves[node], saved[node])
                + (None, digest)
            )
    return [*nodes, *edges, *ends]


def _lists(column: pa.Array) -> list[list[int]]:
    return column.to_pylist()


def shards(sorted_sequences: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """The rows of all shards; ``sorted_sequences`` lie in ranges of (ids, conv_id), sorted."""
    most = shard_turns or SHARD_TURNS

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.values(), strict=True)], list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        convs, ids, words, size = [], [], [], 0
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for i in range(0, batch.num_rows, 512):  # lists of the whole batch are never in work together
                part = batch.slice(i, 512)
                for c, x, w, n in zip(
                    part.column(0).to_pylist(), _lists(part.column(1)), _lists(part.column(2)), sizes[i : i + 512].tolist(), strict=True
                ):
                    if convs and size + n + 1 > most:
                        yield batch_of(shard_rows(shard, convs, ids, words))
                        shard += 1
                        convs, ids, words, size = [], [], [], 0
                    convs.append(c)
                    ids.append(x)
                    words.append(w)
                    size += n + 1
        if convs:
            yield batch_of(shard_rows(shard, convs, ids, words))

    return sorted_sequences.select("conv_id", "ids", "words").mapInArrow(run, _SCHEMA)


# ---- boundary nodes -----------------------------------------------------------


def ends_digests(runs: DataFrame) -> DataFrame:
    """``(key, ends)``: the digest of the ids that end at each key, from runs that come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if hashed:
                        done.append((key, hashed.hexdigest()))
                    key, hashed = k, hashlib.sha256()
                else:
                    hashed.update(b",")
                hashed.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "digest"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hashed.hexdigest()])], ["key", "digest"])

    ordered = runs.select("key", "ends", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.select("key", "ends").mapInArrow(run, "key binary, digest string")


def merged_boundary(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """The final boundary nodes with their keys."""
    one = tables.kept(
        edges.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.first("parent_key", ignorenulls=True).alias("parent_key"),
            F.max("words").alias("words"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.min(F.struct("shard", "side")).alias("stands"),
        ),
        "trie-merged",
    )
    children = one.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    own = one.join(children.filter(F.col("key").isNotNull()), "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))
    )
    own = own.withColumns(
        {
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    own = tables.kept(own.drop("more"), "trie-own-numbers")
    standing = own.select("key", "stands.shard", "stands.side", "n_leaves", "saved_tokens")
    paths = edges.select("shard", "side", "depth", "key").join(standing, ["key", "shard", "side"], "left")
    upwards = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc())
    sums = [F.sum(F.coalesce(c, F.lit(0))).over(upwards).alias(c) for c in ("n_leaves", "saved_tokens")]
    totals = paths.select("key", *sums).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    parents = own.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (
        own.drop("n_leaves", "saved_tokens")
        .join(totals, "key")
        .join(parents, "parent_key", "left")
        .join(tables.kept(ends_digests(runs), "trie-ends"), "key", "left")
        .withColumn("ends", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)))
    )


def trie(sequences: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """A row per node of the trie; ``sequences`` has ``conv_id``, ``ids`` and ``words``."""
    sequences = tables.kept(sequences, "trie-sequences")
    ranged = sequences.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    rows = tables.kept(shards(ranged, shard_turns), "trie-shards", "kind")
    edges, runs, nodes = (rows.filter(F.col("kind") == k).drop("kind") for k in (EDGE, ENDS, NODE))
    boundary = tables.kept(merged_boundary(edges, runs), "trie-boundary")
    names = edges.select("shard", "key").distinct().join(boundary.select("key", F.col("conv_id").alias("named")), "key")
    names = tables.kept(names.select("shard", F.col("key").alias("parent_key"), "named"), "trie-names")
    hanging = nodes.filter(F.col("parent_key").isNotNull()).join(names, ["shard", "parent_key"])
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return (
        nodes.filter(F.col("parent_key").isNull())
        .select(*shown)
        .unionByName(hanging.drop("parent_conv_id").withColumnRenamed("named", "parent_conv_id").select(*shown))
        .unionByName(boundary.select(*shown))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(tables.table(spark, sf_dir, "conversations"))))
