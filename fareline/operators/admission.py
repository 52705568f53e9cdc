"""Seats for requests in order of arrival, all seats of a request or none.

A request gets its seats if nobody holds one of them and no earlier request that got in asks
for one; a refused request holds nothing, so its seats stay free for the next. Read as a graph,
requests are in conflict when they share a seat of a route and day, and the ones admitted are
the maximal independent set that going through them one by one gives. It is found in rounds:
a request that is the first of all that are left at each of its seats gets in, and those in
conflict with it are refused. The earliest one left always gets in, so the rounds end by
themselves, and a trip takes no more of them than it has seats.

Of requests for the very same seats only the first can get in, so the rounds work on one
request per set of seats: a trip that everybody asks for stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.session import enable_checkpoints, stored

SEAT = ["route_id", "journey_date", "seat_id"]
DAY = ["route_id", "journey_date"]

# The requests admitted so far are written out again after this many rounds, to keep plans short.
ROUNDS_PER_FOLD = 16


def _seat_rows(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "at", *DAY, F.explode("seats").alias("seat_id"))


def _with_free_seats(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Requests none of whose seats is held."""
    asked = _seat_rows(requests)
    # The seats asked for are few beside those held: they choose which holds are read further. Stored,
    # so that their size is known before the holds are shuffled to meet them.
    wanted = stored(asked.select(*SEAT).distinct(), "wanted-seats")
    taken = stored(held.select(*SEAT).join(wanted, SEAT, "left_semi").distinct(), "held-seats")
    blocked = stored(asked.join(taken, SEAT, "left_semi").select("request_id").distinct(), "blocked-requests")
    return requests.join(blocked, "request_id", "left_anti")


def first_come(requests: DataFrame, held: DataFrame) -> DataFrame:
    """The ``request_id`` of the requests that get all their seats.

    ``requests``: distinct ``request_id``, their order of arrival ``at``, ``route_id``,
    ``journey_date`` and ``seats``, an array of seat ids. ``held``: the seats taken before.
    """
    enable_checkpoints(requests.sparkSession)
    sets = F.sort_array(F.array_distinct(F.array_compact("seats")))
    plain = requests.select("request_id", "at", *DAY, sets.alias("seats"))
    # Without a seat, a route or a day a request is in conflict with nobody, not even with its twins.
    free = (F.size("seats") == 0) | F.col("route_id").isNull() | F.col("journey_date").isNull()
    admitted, plain = plain.filter(free).select("request_id"), plain.filter(~free)
    first = plain.groupBy(*DAY, "seats").agg(F.min(F.struct("at", "request_id")).alias("first"))
    first = first.select("first.request_id", "first.at", *DAY, "seats")
    left = stored(_with_free_seats(stored(first, "seat-requests"), held), "open-requests")
    rounds = 0
    while not left.isEmpty():
        rows = _seat_rows(left)
        at_seat = rows.groupBy(*SEAT).agg(F.min(F.struct("at", "request_id")).alias("first"))
        n_first = at_seat.groupBy(F.col("first.request_id").alias("request_id")).agg(F.count(F.lit(1)).alias("n"))
        wins = left.join(n_first, "request_id").filter(F.col("n") == F.size("seats")).drop("n")
        wins = stored(wins, "admitted-requests")
        taken = stored(_seat_rows(wins).select(*SEAT), "taken-seats")
        out = rows.join(taken, SEAT, "left_semi").select("request_id").distinct()
        left = stored(left.join(stored(out, "decided-requests"), "request_id", "left_anti"), "open-requests")
        admitted = admitted.unionByName(wins.select("request_id"))
        rounds += 1
        if rounds % ROUNDS_PER_FOLD == 0:
            admitted = stored(admitted, "admitted-so-far")
    return admitted
