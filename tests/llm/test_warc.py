from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dayrank.llm import warc
from dayrank.session import fresh_path
from tests.conftest import SF
from tests.llm.helpers import CLASHING, sorted_rows

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages(spark, rows):
    data = [(*r, *["x"] * len(CLASHING.split(", "))) for r in rows]
    return spark.createDataFrame(data, f"page_id long, url string, html string, {CLASHING}")


def wanted(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        head = first.get(html or "")
        revisit = len(raw) >= 100 and head is not None and i != head
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


ODD = [
    (3, "http://a.example/x", "p" * 200), (2, "https://www.A.example:443/x?q#f", "p" * 200), (9, None, "p" * 200),
    (4, "http://b.example/", "short"), (5, "http://b.example/", "short"), (6, "", None), (7, "not a url\r\nat all", ""),
    (8, "http://[bad", "line\r\n\r\nWARC/1.1\r\n\r\nends\r\n\r\n" * 9), (None, "http://c.example", "é" * 99),
    (10, "http://c.example", "é" * 99), (2, "https://www.A.example:443/x?q#f", "p" * 200), (11, "http://d.example", "漢" * 400_000),
]


def test_odd_pages(spark):
    found = warc.archive_and_index(pages(spark, ODD))
    assert sorted_rows(found, *COLUMNS) == wanted(ODD)


def test_repeated_payloads_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    monkeypatch.setattr(warc, "HOT_ROWS", 2)
    rows = ODD + [(i, f"http://e.example/{i}", "same page " * 20) for i in range(100, 140)]
    assert sorted_rows(warc.archive_and_index(pages(spark, rows)), *COLUMNS) == wanted(rows)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_dates_are_utc_in_every_session(spark, zone):
    """Also where the session's clock is set back or forward."""
    before = spark.conf.get("spark.sql.session.timeZone")
    moments = [1_710_053_940 + 1800 * k for k in range(-6, 7)] + [1_730_613_600 + 1800 * k for k in range(-6, 7)] + [0, -1, 86_399]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(i, "http://a.example/", "x", s) for i, s in enumerate(moments)], "page_id long, url string, html string, s long")
        frame = frame.withColumn("time", F.timestamp_seconds("s"))
        texts = {r.page_id: r.captured_at for r in warc.records(frame, "page_id", "url", "html", "time").collect()}
        path = fresh_path(spark, "warc")
        warc.write_archives(warc.records(frame, "page_id", "url", "html", "time"), path)
        index = warc.merge_runs(warc.read_runs(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for i, s in enumerate(moments):
        assert texts[i] == (datetime(1970, 1, 1) + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert [r.page_id for r in index] == [i for i, _ in sorted(enumerate(moments), key=lambda x: (x[1], x[0]))]


def test_empty_table(spark):
    assert warc.archive_and_index(pages(spark, [])).count() == 0


def test_archives_hold_the_payloads(spark):
    path = fresh_path(spark, "warc")
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(warc.records(frame, "page_id", "url", "html"), path, archive_bytes=100_000)
    html = {r.page_id: (r.html or "").encode() for r in frame.collect()}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 5
    for file in files:
        for capture, payload in warc.parse_archive(file.path, bytes(file.content)):
            record = file.content[capture["offset"] : capture["offset"] + capture["length"]]
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            if capture["record_type"] == "response":
                assert payload == html[capture["page_id"]]
    damaged = bytes(files[0].content).replace(b"<html", b"<HTML", 1)
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parse_archive("x", damaged))
    with pytest.raises(ValueError):
        list(warc.parse_archive("x", bytes(files[0].content)[:-7]))


def test_index_is_globally_ordered(spark):
    path = fresh_path(spark, "warc")
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(warc.records(frame, "page_id", "url", "html"), path, archive_bytes=100_000)
    runs = warc.read_runs(spark, path)
    index = warc.merge_runs(runs, range_rows=20).collect()  # partitions come in order
    captures = [r.asDict() for r in index]
    assert len(captures) == frame.count()
    assert [warc.order_of(c) for c in captures] == sorted(warc.order_of(c) for c in captures)


def test_loser_tree():
    r = random.Random(1)
    for _ in range(300):
        runs = [sorted(r.randint(0, 20) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 9))]
        assert list(warc.LoserTree([(x, x) for x in run] for run in runs)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("https://www.Blog.example.net:8080/en/25?x#top") == "net,example,blog:8080)/en/25?x"
    assert warc.url_key("http://a.b:80") == "b,a)/"
    assert warc.url_key(None) == warc.url_key("") == ""
