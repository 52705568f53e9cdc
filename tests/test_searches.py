"""A table of searches against one search after the other."""

import re

import pytest
from pyspark.sql import functions as F

from fareline.operators import counters, searches
from tests.tiny import dicts, frame

CITIES = ["Dhaka", "DHAKA East", "Sylhet", "Süd_Stadt", "Sud%Stadt", "a", "", None, "x" * 200, "back\\slash", "Chittagong", "안동"]
TEXTS = [
    "", "0", None, "dha", " DHAKA ", "d%a", "_", "%", "____", "s_d", "süd\\_", "sud\\%s", "a", "ka", "zz", "tt_g", "<b>syl</b>het",
    "xxx", "\\", "back\\\\s", "안", "h%t", "%%", "tagongs",
]


def world(spark):
    routes = [
        {"route_id": i * 100 + j, "origin_city": o, "destination_city": d, "is_active": 1 if (i + j) % 5 else 0}
        for i, o in enumerate(CITIES)
        for j, d in enumerate(CITIES)
    ]
    links = spark.createDataFrame([(i % 3, r["route_id"]) for i, r in enumerate(routes) if i % 4], "bus_id long, route_id long")
    return frame(spark, "routes", routes), links


def test_against_one_search_after_the_other(spark):
    routes, links = world(spark)
    asked = [(i, o, TEXTS[(i * 7 + k) % len(TEXTS)]) for k in range(3) for i, o in enumerate(TEXTS)]
    asked = [(n, o, d) for n, (_, o, d) in enumerate(asked)]
    batch = searches.search_batch(spark.createDataFrame(asked, "search_id long, origin string, destination string"), routes, links)
    found = {}
    for r in dicts(batch.found):
        found.setdefault((r["origin"], r["destination"]), set()).add((r["route_id"], r["available_buses"]))
    inquiry = {r["search_id"]: (r["origin"], r["destination"]) for r in dicts(batch.searches)}
    counts = {r["search_id"]: r["routes_found"] for r in dicts(searches.search_counts(batch))}
    # All searches in one plan would be a union of as many; the plain form is checked by its counts.
    plain = None
    for n, o, d in asked:
        one = counters.search_routes(routes, links, o, d, ordered=False).select(F.lit(n).alias("n"), "route_id", "available_buses")
        if n % 3 == 0:
            plain = one if plain is None else plain.unionByName(one)
    want = {}
    for r in plain.collect():
        want.setdefault(r["n"], set()).add((r["route_id"], r["available_buses"]))
    for n, _, _ in asked:
        assert counts[n] == len(found.get(inquiry[n], set()))
        if n % 3 == 0:
            assert found.get(inquiry[n], set()) == want.get(n, set()), asked[n]


@pytest.mark.parametrize("text", ["dhaka", "d%a", "_", "", "süd\\_", "a\\\\b", "ab%cdef_g", "\\x"])
def test_runs_of_a_pattern_are_in_every_match(spark, text):
    row = spark.range(1).select(searches.pattern_runs(F.lit(text)).alias("r")).first()["r"]
    literal = re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)[%_]", "\x01", text)).split("\x01")
    assert row and all(any(run in part for part in literal) for run in row)
    assert max(map(len, row)) == min(3, max(map(len, literal)))


def test_no_nested_loops_and_few_candidates(spark):
    routes, links = world(spark)
    asked = spark.range(50).selectExpr("id AS search_id", "concat('dha', id % 3) AS origin", "'' AS destination")
    batch = searches.search_batch(asked, routes, links)
    for df in (batch.found, searches.search_counts(batch)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    patterns = spark.createDataFrame([("dhaka",), ("",)], "pattern string")
    cities = routes.select(F.lower("origin_city").alias("city")).distinct()
    plan = searches.matching_cities(patterns, cities)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_to_search(spark):
    routes, links = world(spark)
    schema = "search_id long, origin string, destination string"
    none = searches.search_batch(spark.createDataFrame([], schema), routes, links)
    assert none.found.count() == 0 and searches.search_counts(none).count() == 0
    some = searches.search_batch(spark.createDataFrame([(1, "dha", "")], schema), routes.limit(0), links)
    assert [r["routes_found"] for r in dicts(searches.search_counts(some))] == [0]
