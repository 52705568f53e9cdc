from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fareline.llm import exact_copies as E
from tests.llm.rows import documents, prose

TEXTS = ["Same", "same", None, "", "sAME", prose(30_000), prose(30_000), "Ä", "ä", *["hot"] * 40, "alone"]


def wanted(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    return {i: (max(g), len(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("turns", [False, True])
def test_groups_and_what_stays(spark, monkeypatch, turns):
    if turns:
        monkeypatch.setattr(E, "ROWS_PER_SEGMENT", 5)
        monkeypatch.setattr(E, "SEGMENTS_AT_ONCE", 3)
    docs = documents(spark, TEXTS)
    want = wanted(TEXTS, range(len(TEXTS)))
    got = {r["doc_id"]: r for r in E.find_copies(docs).collect()}
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["keep_id"] == i) for i, r in got.items())
    stay = E.drop_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted({k for k, _ in want.values()})


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a", "a", "b", "b", "c"], ids=[1, 1, None, 2, None])
    rows = E.find_copies(docs).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in rows) == [
        (-1, -1, 1), (-1, 2, 2), (1, 1, 2), (1, 1, 2), (2, 2, 2)]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in E.drop_copies(docs).collect()) == [(-1, "c"), (1, "a"), (2, "b")]


def test_empty_table(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert E.find_copies(docs).count() == 0
    assert E.drop_copies(docs).count() == 0


def test_three_turns_shuffle_suspects_only(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_SEGMENT", 4)
    monkeypatch.setattr(E, "SEGMENTS_AT_ONCE", 4)
    texts = [*[f"text {i}" for i in range(40)], *["hot"] * 8]
    docs = documents(spark, texts)
    stored, turns, (sha, segment, turn) = E.by_turn(docs)
    assert turns == 3 and stored.groupBy(turn).count().count() == 3
    shuffled, passed = 0, 0
    for k in range(turns):
        part = stored.filter(F.col(turn) == k).drop(turn)
        with E._filter_of(part.select(F.col(segment).alias("segment"), F.col(sha).alias("text_sha256"))) as maybe:
            left = E.one_turn(part, maybe, sha, segment)
            plan = left._jdf.queryExecution().executedPlan().toString()
            straight, suspects = plan.split("SortAggregate" if "SortAggregate" in plan else "HashAggregate")[0], plan
            assert "Exchange" not in straight and "Exchange" in suspects
            flags = part.select(maybe(sha, segment).alias("maybe")).collect()
            shuffled += sum(r["maybe"] for r in flags)
            passed += sum(not r["maybe"] for r in flags)
    assert shuffled >= 8 and passed >= 30
    got = E.drop_copies(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # every turn was written
    assert sorted(r["text"] for r in got.collect()) == sorted({*texts})


def test_filters_are_taken_back(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_SEGMENT", 4)
    monkeypatch.setattr(E, "SEGMENTS_AT_ONCE", 4)
    alive, most = set(), []
    make = type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        handed = make(sc, value)
        alive.add(id(handed))
        most.append(len(alive))
        destroy = handed.destroy
        handed.destroy = lambda *a: (alive.discard(id(handed)), destroy(*a))
        return handed

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    E.drop_copies(documents(spark, [f"t{i}" for i in range(50)]))
    E.find_copies(documents(spark, [f"t{i}" for i in range(50)]))
    assert len(most) >= 6 and max(most) == 1 and not alive
