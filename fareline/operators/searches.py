"""Route search for a whole table of searches at once.

One search filters the routes by a pattern for either city. For many, the different patterns
meet the different cities through an inverted index: the runs of one to three characters that
a city's name holds. A pattern asks for the rarest of the runs that its literal parts must
hold, so it meets only cities that hold this run, and the pattern itself decides. A pattern
without a literal character, or none, asks for the empty run, which every city holds.

Searches for the same two texts are one inquiry, and inquiries meet pairs of cities rather
than routes. Results are kept by inquiry: what a popular search finds is found, and stored,
once. Nothing is joined but on equal runs, patterns or cities.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.functions.text import contains_pattern, is_empty, sanitize, text_key
from fareline.operators.counters import available_buses
from fareline.operators.filters import active_routes
from fareline.session import stored

RUN = 3
# Stands for a city that is missing: found only where no city is asked for.
NO_CITY = "\x00"
# Stand for an escaped backslash, percent sign and underscore while a pattern is cut.
_ESCAPED = "\ue000\ue001\ue002"


class SearchBatch(NamedTuple):
    """``searches``: every search with its inquiry. ``found``: the routes of each inquiry."""

    searches: DataFrame
    found: DataFrame


def _text(name: str) -> Column:
    """What a search compares by; empty where it does not filter."""
    clean = sanitize(F.col(name))
    return F.when(is_empty(clean), "").otherwise(text_key(clean)).alias(name)


def _runs_of_length(text: Column, n: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
    return F.when(F.char_length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, n))).otherwise(
        F.array().cast("array<string>")
    )


def city_runs(city: Column) -> Column:
    """Every run of up to ``RUN`` characters of a name, and the empty one."""
    lengths = [_runs_of_length(city, F.lit(n)) for n in range(1, RUN + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *lengths))


def pattern_runs(text: Column) -> Column:
    """Runs that every match holds: the longest ones of each literal part of a pattern."""
    pattern = contains_pattern(text)
    marked = F.replace(pattern, F.lit("\\\\"), F.lit(_ESCAPED[0]))
    marked = F.replace(F.replace(marked, F.lit("\\%"), F.lit(_ESCAPED[1])), F.lit("\\_"), F.lit(_ESCAPED[2]))
    parts = F.filter(F.split(marked, "[%_]"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.translate(p, _ESCAPED, "\\%_"))
    runs = F.flatten(F.transform(plain, lambda p: _runs_of_length(p, F.least(F.char_length(p), F.lit(RUN)))))
    return F.when(F.size(runs) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(runs))


def matching_cities(patterns: DataFrame, cities: DataFrame) -> DataFrame:
    """``(pattern, city)`` of all matches; either side holds different values only."""
    index = stored(cities.select("city", F.explode(city_runs(F.col("city"))).alias("run")), "city-runs")
    frequency = stored(index.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run-counts")
    asked = patterns.select("pattern", F.explode(pattern_runs(F.col("pattern"))).alias("run"))
    # A run that no city holds: the pattern has no match.
    rated = asked.join(frequency, "run", "left").groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("rarest")
    )
    chosen = stored(rated.filter(F.col("rarest.n") > 0).select("pattern", "rarest.run"), "chosen-runs")
    pairs = chosen.join(index, "run")
    real = F.col("city") != NO_CITY
    holds = F.like(F.col("city"), contains_pattern(F.col("pattern")))
    return pairs.filter((F.col("pattern") == "") | (real & holds)).select("pattern", "city")


def search_batch(searches: DataFrame, routes: DataFrame, bus_route: DataFrame) -> SearchBatch:
    """All of :func:`fareline.operators.counters.search_routes` for a table of searches.

    ``searches`` has ``search_id``, ``origin`` and ``destination`` as they were typed in. The
    inquiry is the pair of texts as they are compared.
    """
    sides = ["origin", "destination"]
    asked = stored(searches.select("search_id", *map(_text, sides)), "searches")
    inquiries = stored(asked.groupBy(*sides).agg(F.count(F.lit(1)).alias("n_searches")), "inquiries")
    shown = available_buses(active_routes(routes), bus_route)
    for side in sides:
        shown = shown.withColumn(f"{side}_key", F.coalesce(text_key(F.col(f"{side}_city")), F.lit(NO_CITY)))
    legs = stored(shown.select(*[F.col(f"{s}_key").alias(f"{s}_key") for s in sides]).distinct(), "legs")
    matches = {}
    for side in sides:
        patterns = inquiries.select(F.col(side).alias("pattern")).distinct()
        cities = legs.select(F.col(f"{side}_key").alias("city")).distinct()
        found = matching_cities(patterns, cities).select(F.col("pattern").alias(side), F.col("city").alias(f"{side}_key"))
        matches[side] = stored(found, "matches")
    # An inquiry starts from the side that fewer cities match, and ends at the other.
    rated = inquiries
    for side in sides:
        counts = matches[side].groupBy(side).agg(F.count(F.lit(1)).alias(f"n_{side}"))
        rated = rated.join(stored(counts, "match-counts"), side)  # no city, no route
    rated = stored(rated, "rated-inquiries")
    out = None
    for first, last in (sides, sides[::-1]):
        mine = F.col("n_origin") <= F.col("n_destination")
        leading = rated.filter(mine if first == "origin" else ~mine).select(*sides, "n_searches")
        at = leading.join(matches[first], first).join(legs, f"{first}_key").join(matches[last], [last, f"{last}_key"])
        out = at if out is None else out.unionByName(at)
    keys = [f"{s}_key" for s in sides]
    found = stored(out, "matching-legs").join(shown, keys).drop(*keys)
    return SearchBatch(asked, found)


def search_counts(batch: SearchBatch) -> DataFrame:
    """How many routes each search finds."""
    sides = ["origin", "destination"]
    counts = stored(batch.found.groupBy(*sides).agg(F.count(F.lit(1)).alias("routes_found")), "found-counts")
    return batch.searches.join(counts, sides, "left").select(
        "search_id", F.coalesce("routes_found", F.lit(0)).alias("routes_found")
    )
