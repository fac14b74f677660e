"""WARC archives of pages, and a globally ordered index of their captures.

Writing: each page becomes a WARC 1.1 record. The records are the rows of a text table whose row
separator is the blank line that ends a WARC record, so Spark's own writer makes the archives in
any file system it reaches, and archives need no shuffle. A payload of at least REVISIT_BYTES that
another record holds too is stored once, with the smallest page id; the others are revisit records
that refer to it and keep the HTTP header with the payload's length.

Index: each archive read back gives one run of captures, sorted by URL key and time. The runs are
cut at common key ranges (so the captures of one URL, however many, may spread over several
ranges, as time and id are part of the key) and each range merges its slices of all runs with a loser
tree. Ranges are in order, so the whole index is.

Defined results: a null payload is empty; a null URL has no target header and an empty key; line
ends in a URL are percent-encoded; without a time a record carries EPOCH. Rows that repeat a page id
and its payload are the same capture stored twice and get the same type. A null page id never is
the one referred to, unless all are null; then each is a response. An empty table gives no
archives and an empty index. Columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dayrank.llm.common import column, ready, sha256_text, small_enough
from dayrank.operators.skew import spread_join
from dayrank.session import fresh_path, materialize

REVISIT_BYTES = 100
#: Bytes of an archive, on average: a reader holds one at a time.
ARCHIVE_BYTES = 8 << 20
#: Captures that one task of the index merges.
RANGE_ROWS = 100_000
#: Repeated payloads up to so many are broadcast to the pages; beyond, both sides are shuffled.
BROADCAST_PAYLOADS = 200_000
#: Pages of one payload that a task of that shuffle takes.
HOT_ROWS = 100_000
EPOCH = "2024-01-01T00:00:00Z"

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = StructType(
    [
        StructField("url_key", StringType()),
        StructField("captured_at", StringType()),
        StructField("page_id", LongType()),
        StructField("archive", StringType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
        StructField("url", StringType()),
        StructField("record_type", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("refers_to", LongType()),
        StructField("place", LongType()),
    ]
)
_NAMES = CAPTURES.fieldNames()
_ARROW = pa.schema(
    [(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in CAPTURES]
)


def utc_text(time: Column) -> Column:
    """A timestamp as WARC writes it, in UTC whatever zone the session is in."""
    seconds = F.unix_seconds(time)
    days = F.floor(seconds / 86_400).cast("int")
    within = F.pmod(seconds, F.lit(86_400)).cast("int")
    clock = [F.floor(within / 3600), F.floor(within / 60) % 60, within % 60]
    text = F.concat_ws(":", *(F.lpad(part.cast("string"), 2, "0") for part in clock))
    day = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.when(time.isNotNull(), F.concat(day, F.lit("T"), text, F.lit("Z")))


def records(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str | None = None
) -> DataFrame:
    """Each page with its payload's length and digest, its record type, and what it refers to."""
    time = F.lit(None).cast("timestamp") if time_col is None else F.col(time_col)
    captured = F.coalesce(utc_text(time), F.lit(EPOCH))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(payload_col, F.lit("")).alias("payload"),
        captured.alias("captured_at"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha256_text(F.col("payload")).alias("payload_digest"),
    )
    # Short payloads are shared by no page; each has a key of its own, so they do not meet in one task.
    is_long = F.col("payload_bytes") >= REVISIT_BYTES
    own = F.concat(F.lit("page:"), F.xxhash64("page_id", "url", "payload_digest").cast("string"))
    rows = rows.withColumn("shared_digest", F.when(is_long, F.col("payload_digest")).otherwise(own))
    first = (
        rows.filter(is_long)
        .groupBy("shared_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
    )
    first = materialize(first, "payloads")
    if small_enough(first, BROADCAST_PAYLOADS):
        known = rows.join(F.broadcast(first.drop("n")), "shared_digest", "left")
    else:
        # A widely repeated page is spread over tasks; such pages are at most the rows by HOT_ROWS.
        hot = first.filter(F.col("n") > HOT_ROWS).select("shared_digest", F.ceil(F.col("n") / HOT_ROWS).alias("copies"))
        known = spread_join(rows, first.drop("n"), ["shared_digest"], hot, ("page_id", "url"))
    is_revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return known.select(
        "page_id",
        "url",
        "captured_at",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
    )


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``records`` as WARC files under the path."""
    ready(rows.sparkSession)
    clean_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_END),
    )
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))

    def header(name: str, value) -> Any:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    refers = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header(
            "WARC-Record-ID",
            F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        ),
        header("WARC-Date", F.col("captured_at")),
        header("WARC-Target-URI", clean_url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        header("WARC-Refers-To", refers),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(_PROFILE))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(_END),
        F.col("block"),
    )
    mean = rows.agg(F.avg("payload_bytes")).first()[0] or 0
    per_archive = max(1, int(archive_bytes / (mean + 600)))
    (
        rows.withColumn("block", block)
        .select(record.alias("value"))
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", per_archive)
        .text(path)
    )


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels from the last to the first, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = ",".join(reversed(host.split(".")))
    if port and (parts.scheme.lower(), port) not in {("http", 80), ("https", 443)}:
        place += f":{port}"
    return f"{place}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def parse_archive(name: str, content: bytes) -> Iterator[tuple[dict[str, Any], bytes]]:
    """(capture, payload) of each record of an archive; raises where it is damaged."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"{name}: no record at byte {at}")
        head = content[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head)}
        begin = end + 4
        stop = begin + int(fields["content-length"])
        if view[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} has another length")
        split = content.find(b"\r\n\r\n", begin, stop) + 4
        http = content[begin:split].decode("ascii").split("\r\n")
        length = int(next(x for x in http if x.lower().startswith("content-length:")).split(":")[1])
        payload = content[split:stop]
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-type"] == "response" and (
            len(payload) != length or hashlib.sha256(payload).hexdigest() != digest
        ):
            raise ValueError(f"{name}: the payload at byte {at} is damaged")

        def page(field: str, fields: dict[str, str] = fields) -> int | None:
            value = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
            return int(value) if value else None

        url = fields.get("warc-target-uri")
        yield {
            "url_key": url_key(url),
            "captured_at": fields["warc-date"],
            "page_id": page("warc-record-id"),
            "archive": name,
            "offset": at,
            "length": stop + 4 - at,
            "url": url,
            "record_type": fields["warc-type"],
            "payload_bytes": length,
            "payload_digest": digest,
            "refers_to": page("warc-refers-to"),
        }, payload
        at = stop + 4


def order_of(capture: dict[str, Any]) -> tuple:
    page = capture["page_id"]
    return (
        capture["url_key"].encode(),
        capture["captured_at"],
        (0, 0) if page is None else (1, page),
        capture["archive"],
        capture["offset"],
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under the path: a sorted run for each archive, ``place`` being
    a capture's place in its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = column(batch, "path").to_pylist()
            for row, name in enumerate(names):
                content = column(batch, "content")[row].as_py()
                captures = sorted((c for c, _ in parse_archive(name.rpartition("/")[2], content)), key=order_of)
                for place, capture in enumerate(captures):
                    capture["place"] = place
                yield pa.RecordBatch.from_pylist(captures, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    ready(spark)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


class LoserTree:
    """Merges sorted runs. Each inner node keeps the loser of the match played there; the winner of
    all matches is the smallest head, and its run's next entry replays one path to the root."""

    def __init__(self, runs: Iterable[Iterable[tuple[Any, Any]]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        count = len(self.runs)
        self.losers = [0] * count
        self.winner = self._play(1) if count else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are the nodes from the number of runs on."""
        count = len(self.runs)
        first: list[int] = [0] * (2 * count)
        for k in range(2 * count - 1, node - 1, -1):
            if k >= count:
                first[k] = k - count
            else:
                a, b = first[2 * k], first[2 * k + 1]
                first[k], self.losers[k] = (a, b) if self._beats(a, b) else (b, a)
        return first[node]

    def __iter__(self) -> Iterator[Any]:
        count = len(self.runs)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            champion = self.winner
            yield self.heads[champion][1]
            self.heads[champion] = next(self.runs[champion], None)
            node = (champion + count) // 2
            while node:
                if self._beats(self.losers[node], champion):
                    champion, self.losers[node] = self.losers[node], champion
                node //= 2
            self.winner = champion


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures, globally ordered by URL key, time and page: over the partitions and in each."""
    spark = ready(runs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[dict[str, Any]]] = {}
        for batch in batches:
            for capture in batch.to_pylist():
                slices.setdefault(capture["archive"], []).append(capture)
        for captures in slices.values():  # blocks of a run may arrive in any order
            captures.sort(key=lambda c: c["place"])
        held: list[dict[str, Any]] = []
        for capture in LoserTree([(order_of(c), c) for c in run] for run in slices.values()):
            held.append(capture)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    by = ["url_key", "captured_at", "page_id", "archive", "offset"]
    return runs.repartitionByRange(parts, *by).mapInArrow(run, CAPTURES)


def archive_and_index(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    time_col: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """Write the pages as archives, read those back, and return the merged index."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    write_archives(records(pages, id_col, url_col, payload_col, time_col), path)
    return merge_runs(materialize(read_runs(spark, path), "runs"))
