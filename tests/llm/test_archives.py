import hashlib

import numpy as np
from pyspark.sql import functions as F

from fareline.llm import archives as A


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


LONG = "<html>é" + "x" * 120
ROWS = [
    (1, "http://Www.Example.com:80/a?b#c", LONG), (2, "https://example.com/", LONG), (3, None, None), (4, "", ""),
    (5, "http://a.b/\r\nX: y", "short"), (6, "http://a.b/", "short"), (9, "http://a.b/", LONG),
    (7, "http://a.b/z", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9), (8, "x", "y" * 300_000),
    (10, "http://a.b/", "e" * 49 + "é" * 26),
]


def test_round_trip(spark, tmp_path):
    pages(spark, [*ROWS, (None, "u", "lost")]).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in A.query(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in ROWS)
    for page, _, html in ROWS:
        payload = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == payload]
        again = len(payload) >= 100 and min(same) < page
        assert got[page]["payload_bytes"] == len(payload)
        assert got[page]["payload_digest"] == hashlib.sha256(payload).hexdigest()
        assert got[page]["record_type"] == ("revisit" if again else "response")
        assert got[page]["refers_to"] == (min(same) if again else None)


def test_files_are_plain_warc(spark, tmp_path):
    A.write_archives(pages(spark, ROWS), str(tmp_path / "w"))
    seen = {}
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        for fields, block, offset, length in A.parse(data):
            assert data[offset : offset + length].endswith(b"\r\n\r\n")
            assert fields["WARC-Type"] in ("response", "revisit")
            seen[fields["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2]
    for page, _, html in ROWS:
        if page not in (2, 9):
            assert seen[f"<urn:page:{page}>"] == (html or "").encode()


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "SIZE_CLASSES", ((1000, 50), (10_000, 4), (1 << 62, 1)))
    rows = [(i, "u", f"{i} " + "z" * (100, 3000, 90_000)[i % 3]) for i in range(120)]
    rows += [(200 + i, "u", rows[2][2]) for i in range(60)]  # revisits of a large page are small records
    A.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert sum(s > 90_000 for s in sizes) == 40 and max(sizes) < 92_000
    index = A.captures(spark, str(tmp_path / "w")).collect()
    assert sorted(r["page_id"] for r in index) == sorted(r[0] for r in rows)
    assert len({r["file"] for r in index if r["record_type"] == "revisit"}) <= 3


def test_columns_with_clashing_names(spark, tmp_path):
    """Extra columns take no part, whatever their names; repeated rows are archived one by one."""
    clash = {n: F.lit("x") for n in ("digest", "size", "value", "first_id", "n", "carried", "url_key", "part")}
    pages(spark, [*ROWS, *ROWS]).withColumns(clash).write.parquet(str(tmp_path / "pages.parquet"))
    pages(spark, ROWS).write.parquet(str(tmp_path / "plain" / "pages.parquet"))
    twice = sorted(map(str, A.query(spark, str(tmp_path)).collect()))
    once = sorted(map(str, A.query(spark, str(tmp_path / "plain")).collect()))
    assert twice == sorted(once * 2)


def test_index_is_in_global_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "RANGE_ROWS", 40)
    rows = [(i, f"http://h{i % 3}.org/p" if i % 2 else "http://hot.org/", f"page {i}") for i in range(400)]
    A.write_archives(pages(spark, rows), str(tmp_path / "w"))
    index = A.merged_index(A.captures(spark, str(tmp_path / "w"))).collect()
    in_order = [(r["url_key"], r["captured_at"], r["page_id"]) for r in sorted(index, key=lambda r: (r["part"], r["place"]))]
    assert in_order == sorted(in_order) and len(in_order) == 400
    assert len({r["part"] for r in index}) > 3


def test_loser_tree():
    rng = np.random.default_rng(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 12)).tolist()) for _ in range(k)]
        assert list(A.LoserTree([iter(r) for r in runs], key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert A.url_key("https://Sub.Example.COM:443/a/B?x=1#top") == "com,example,sub)/a/B?x=1"
    assert A.url_key("") == ")/"


def test_empty_table(spark, tmp_path):
    pages(spark, ROWS).limit(0).write.parquet(str(tmp_path / "pages.parquet"))
    assert A.query(spark, str(tmp_path)).count() == 0
