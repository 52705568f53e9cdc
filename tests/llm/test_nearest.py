import numpy as np
import pytest
from pyspark.sql import functions as F

from fareline.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=20):
    whole = {
        i: np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)).astype(object)
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = set()
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted(
            ((-sum(int(a) * int(b) for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)
        )[:k]
        out |= {(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scored)}
    return out


def answer(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"shard": F.lit(1), "v": F.lit(2), "id": F.lit(3)})
    df.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return N.query(spark, str(tmp_path))


@pytest.mark.parametrize("shards", [False, True])
def test_against_all_scores(spark, tmp_path, monkeypatch, shards):
    if shards:
        monkeypatch.setattr(N, "SHARD_ROWS", 40)
        monkeypatch.setattr(N, "QUERY_ROWS", 10)
        monkeypatch.setattr(N, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.3, 6).tolist()) for i in rng.permutation(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [float("inf")]), (2080, []), (2100, [0.5]), (None, [1.0])]
    got = {tuple(r) for r in answer(spark, tmp_path, rows).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain(rows)


def test_rows_that_share_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "SHARD_ROWS", 16)
    monkeypatch.setattr(N, "LEAF_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 0.3, 4).tolist()) for i in range(80)]
    rows += [(0, rows[5][1]), (0, rows[0][1]), (20, rng.normal(0, 0.3, 4).tolist()), (7, rows[7][1]), (7, rows[9][1])]
    whole = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)).astype(int)) for i, v in rows]
    want = []
    for q in (0, 20, 40, 60):
        scored = sorted((-int(a @ b), c) for i, a in whole if i == q for c, b in whole if c != q)[:20]
        want += [(q, rank + 1, c, -s) for rank, (s, c) in enumerate(scored)]
    assert sorted(tuple(r) for r in answer(spark, tmp_path, rows).collect()) == want


def test_large_components(spark, tmp_path):
    rows = [(i, [float(2**20 + i), -3.0e5]) for i in range(45)]
    got = {tuple(r) for r in answer(spark, tmp_path, rows).collect()}
    assert got == plain(rows)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(0, [1.0]), (1, [2.0])]
    out = answer(spark, tmp_path, rows)
    assert [tuple(r) for r in out.collect()] == [(0, 1, 1, 8192)]
    assert [d for _, d in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert answer(spark, tmp_path, [(0, None)]).count() == 0
