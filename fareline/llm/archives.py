"""Web archives: writing WARC records, reading them back, and an ordered capture index.

Records are written as text files in the shared work folder: a record ends in CR LF CR LF,
the last LF being the writer's line end, so a file is a plain sequence of WARC/1.1 records.
Records of one size class share files, fewer to a file the larger they are, so a file holds
about 64 MB at most or a single record. Files are read whole and cut by Content-Length, so a
payload may hold anything.

Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the smallest page id
is a response and the others are revisits of it. Null html is an empty payload, a null url
an empty one; line breaks in a url are written percent-encoded. A page id that is null
takes no part; rows that repeat a page id and its payload are archived one by one with the
same type. A crawl time that is not given is derived from the id.

The index is an external merge. Every archive file gives a run sorted by URL key, time and
page id; sampled bounds cut the key range into slices, each slice of each run is sent to
the task of its range, and there a loser tree merges the slices of all runs. Read by range,
the result is in global order, so all captures of a URL follow each other in time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.llm import tables
from fareline.session import work_folder

NAME = "op8_archives"
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

REVISIT_BYTES = 100
#: Payload bytes up to which records share files, and how many a file has.
SIZE_CLASSES = ((64 << 10, 1000), (1 << 20, 64), (16 << 20, 4), (1 << 62, 1))
#: Index rows that a range holds on average.
RANGE_ROWS = 50_000
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIRST_CAPTURE = 1_700_000_000
INDEX = "url_key string, captured_at string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
_ORDER = ["url_key", "captured_at", "page_id"]


# ---- writing ----------------------------------------------------------------


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record per row of ``pages(page_id, url, html)``, without the last line feed.

    ``size`` is the bytes of the page, ``carried`` those that the record has of it.
    """
    rows = pages.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha2("html", 256)})
    long_ones = F.col("size") >= REVISIT_BYTES
    firsts = tables.kept(
        rows.filter(long_ones).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"),
        "warc-firsts",
    )
    told = rows.join(firsts, "digest", "left")
    revisit = F.col("first_id") < F.col("page_id")  # null where the payload is alone or short
    at = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.col("page_id"), F.lit(100_000_000)))

    def field(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))

    shared = [
        field("WARC-Record-ID", _record_id(F.col("page_id"))),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("Content-Type", "application/http; msgtype=response"),
    ]
    response = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\n"), *shared,
        field("Content-Length", (F.col("size") + len(HTTP_HEAD)).cast("string")),
        F.lit(f"\r\n{HTTP_HEAD}"), "html", F.lit("\r\n\r"),
    )
    repeat = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: revisit\r\n"), *shared,
        field("WARC-Profile", REVISIT_PROFILE),
        field("WARC-Refers-To", _record_id(F.col("first_id"))),
        field("Content-Length", str(len(HTTP_HEAD))),
        F.lit(f"\r\n{HTTP_HEAD}\r\n\r"),
    )
    carried = F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    return told.select(F.when(revisit, repeat).otherwise(response).alias("value"), "size", carried.alias("carried"))


def write_archives(pages: DataFrame, path: str) -> None:
    found = records(pages)
    # Read the pages again only for classes that they have.
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    above = -1
    for limit, per_file in SIZE_CLASSES:
        one = found.filter((F.col("carried") > above) & (F.col("carried") <= limit))
        if above >= 0:
            one = one.filter(F.col("size") > above)  # for the scan: before digests and the join
        one.select("value").write.mode("append").option("maxRecordsPerFile", per_file).text(path)
        above = limit
        if longest <= limit:
            break


# ---- reading ----------------------------------------------------------------

_LINE = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, offset and length of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION.encode() + b"\r\n", at):
            raise ValueError(f"no WARC record at byte {at}")
        head_end = data.index(b"\r\n\r\n", at) + 2
        fields = {k.decode(): v.decode() for k, v in _LINE.findall(data[at:head_end])}
        start = head_end + 2
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield fields, data[start:end], at, end + 4 - at
        at = end + 4


def url_key(url: str) -> str:
    """Host names from the last to the first, then path and query; scheme, port 80 or 443 and fragment go."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.split("#")[0], flags=re.IGNORECASE)
    host, slash, path = rest.partition("/")
    host = re.sub(r":(80|443)$", "", host.lower())
    return ",".join(reversed(host.split("."))) + ")" + (slash + path or "/")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """An index row per record of the archives below ``path``, a sorted run per file.

    Digest and length of a response are taken from its payload and must agree with its
    header; a revisit has no payload, its length is null here.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for fields, block, offset, length in parse(content):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, refers = None, None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                    else:
                        refers = int(_PAGE.fullmatch(fields["WARC-Refers-To"])[1])
                    page = int(_PAGE.fullmatch(fields["WARC-Record-ID"])[1])
                    key = url_key(fields["WARC-Target-URI"])
                    rows.append((key, fields["WARC-Date"], page, fields["WARC-Type"], refers, digest, size, file, offset, length))
                run = pd.DataFrame(sorted(rows, key=lambda r: r[:3]), columns=[c.split()[0] for c in INDEX.split(", ")])
                yield run.astype({"refers_to": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInPandas(read, INDEX)


# ---- merging ----------------------------------------------------------------


class LoserTree:
    """Merges sorted sequences; a step costs one comparison per level of the tree."""

    def __init__(self, runs: list[Iterator], key: Callable[[Any], Any]) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        one, two = self.heads[a], self.heads[b]
        return two is None or (one is not None and one[:2] < two[:2])

    def _play(self, i: int) -> None:
        """Run ``i`` plays from its leaf to the root; losers stay at the nodes, the winner goes on."""
        node = (i + self.k) >> 1
        while node > 0:
            other = self.losers[node]
            if other < 0:  # first at this node: waits for its opponent
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node >>= 1
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][2]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def merged_index(runs: DataFrame) -> DataFrame:
    """All index rows in global order by URL key, time and page id.

    ``runs`` as :func:`captures` gives them. ``part`` numbers the ranges and ``place`` the
    rows inside one: ordered by both, the table is one sorted index.
    """
    runs = tables.kept(runs, "warc-runs")
    parts = max(1, -(-runs.count() // RANGE_ROWS))
    columns = [c.split()[0] for c in INDEX.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True):
                slices.setdefault(row[7], []).append(row)
        for run in slices.values():  # blocks of one run may arrive in any order
            run.sort(key=lambda r: r[:3])
        tree = LoserTree([iter(r) for r in slices.values()], key=lambda r: r[:3])
        rows, place, part = [], 0, TaskContext.get().partitionId()
        out = [*columns, "part", "place"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i in (0, 1, 3, 5, 7) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], out
            )

        for row in tree:
            rows.append((*row, part, place))
            place += 1
            if len(rows) == 10_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    # The page id makes the bounds cut inside a URL with very many captures, too.
    ranged = runs.repartitionByRange(parts, *_ORDER)
    return ranged.mapInArrow(merge, f"{INDEX}, part long, place long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc")
    write_archives(tables.table(spark, sf_dir, "pages"), path)
    index = tables.kept(merged_index(captures(spark, path)), "warc-index")
    # A revisit's payload is that of the response it names.
    sizes = tables.kept(
        index.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("told")),
        "warc-sizes",
    )
    own = index.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    again = index.filter("record_type = 'revisit'").drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"]).select(
        "page_id", F.col("told").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
    return own.unionByName(again)
