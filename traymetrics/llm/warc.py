"""Operator 6, WARC archives: write pages, read them back by boundary-chain verification.

Writing: one archive file per task, plain WARC/1.0 records. Pages with equal payloads of some size
become revisit records of the one with the largest page_id.

Reading: tasks split the files at every occurrence of the record magic, wherever it stands, and emit
for each the offset of a candidate record and of the record its length leads to. Only candidates on
the chain that starts at the beginning of a file are records; magic inside a payload is never
reached. Stretches where each candidate leads to the next one are contracted first, then pointers
are doubled, so the rounds grow with the logarithm of the interruptions in a file. A payload that
holds magic is put together again from its pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traymetrics.llm.common import land, null_as_empty, query, table
from traymetrics.session import scratch_path

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
SMALLEST_REVISIT = 1000  # bytes of payload
BROADCAST_ROWS = 100_000  # duplicated payloads up to this many (about 10 MB) are broadcast, more are joined by shuffle
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks cannot enter a header."""
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\r\n]", ""), F.lit("\r\n"))).otherwise("")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST_REVISIT, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row of ``pages`` under ``path``; a null html is an empty payload.

    Rows that repeat the largest page_id of a group are all responses. Without a url the record has
    no target.
    """
    payload = null_as_empty(html)
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("html"), F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("sha1"))
    groups = rows.filter(F.col("n") >= smallest).groupBy("sha1", "n").agg(F.count(F.lit(1)).alias("c"), F.max("id").alias("first")).filter("c > 1").drop("c")
    groups = land(groups, "copies")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    rows = rows.join(groups.withColumn("grouped", F.lit(True)), ["sha1", "n"], "left")
    revisit = F.coalesce(F.col("grouped") & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(GAP))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(GAP),
        http,
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)  # each record ends in the gap


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header"), rf"(?im)^{name}: *(.*?)\r?$", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): the text after each magic, up to the next one."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic before the piece: sums within a block, then over the blocks of a file."""
    step = F.col("bytes") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("local", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return local.join(blocks, ["file", "block"]).withColumn("at", F.col("base") + F.col("local") - len(MAGIC)).drop("base", "local")


def _parsed(pieces: DataFrame) -> DataFrame:
    """Candidate records without their text: header fields and, if all bytes are there, the payload's digest."""
    parsed = pieces.withColumn("bytes", F.octet_length("value")).withColumn("header", F.substring_index("value", GAP, 1))
    length = F.regexp_extract("header", r"(?im)^Content-Length: *(\d{1,18})\r?$", 1)
    parsed = parsed.withColumn("length", F.when(length != "", length.cast("long")))
    head = F.octet_length("header") + len(GAP)
    whole = F.col("bytes") == head + F.col("length") + len(GAP)
    block = F.substring(F.col("value").cast("binary"), head + 1, F.col("length").cast("int"))
    parsed = parsed.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("content", F.when(F.col("whole"), block))
    return parsed.select(
        "file",
        "block",
        "seq",
        "bytes",
        (len(MAGIC) + head + F.col("length") + len(GAP)).alias("span"),
        (len(MAGIC) + head).alias("body_at"),
        "whole",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Payload-Digest").alias("stated"),
        *_payload(F.col("content")),
    )


def _payload(content: Column) -> list[Column]:
    """Of an HTTP message: its stated length, its payload's bytes and SHA-1."""
    http = F.substring_index(content.cast("string"), GAP, 1)
    payload = F.substring(content, F.octet_length(http) + len(GAP) + 1, F.lit(2**31 - 1))
    stated = F.regexp_extract(http, r"(?im)^Content-Length: *(\d{1,18})\r?$", 1)
    return [F.when(stated != "", stated.cast("long")).alias("http_length"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1")]


def reachable(candidates: DataFrame) -> DataFrame:
    """Rows of (file, at, next, ..) on the chain from offset 0 of their file."""
    order = Window.partitionBy("file").orderBy("at")
    rows = candidates.withColumn("straight", F.coalesce(F.lead("at").over(order) == F.col("next"), F.lit(False)))
    entered = rows.filter(~F.col("straight") & F.col("next").isNotNull()).select("file", F.col("next").alias("at"), F.lit(True).alias("entered")).distinct()
    rows = rows.join(entered, ["file", "at"], "left")
    opens = ~F.coalesce(F.lag("straight").over(order), F.lit(False)) | F.col("entered").isNotNull()
    rows = land(rows.withColumn("run", F.sum(opens.cast("long")).over(order)).drop("entered", "straight"), "candidates")
    jumps = land(rows.groupBy("file", "run").agg(F.min("at").alias("at"), F.max_by("next", "at").alias("next")), "jumps")
    runs, reached = jumps.select("file", "run", "at"), jumps.filter("at = 0").select("file", "at")
    count = reached.count()
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = land(reached.union(step.join(jumps.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count, far = now, jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = land(jumps.join(far, ["file", "next"], "left").select("file", "at", F.col("far").alias("next")), "jumps")
    on_chain = runs.join(reached, ["file", "at"]).select("file", "run")
    return rows.join(on_chain, ["file", "run"], "left_semi").drop("run")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, at, record_type, record_id, refers_to, payload_bytes, payload_digest.

    A revisit's payload is the one its headers describe; any other record's is the one in its block,
    checked against nothing but the chain of lengths. An archive that breaks off keeps the records
    before the break.
    """
    pieces = _pieces(spark, path)
    candidates = _with_offsets(_parsed(pieces)).filter("at >= 0").withColumn("next", F.col("at") + F.col("span"))
    records = land(reachable(candidates), "records")
    broken = records.filter(~F.col("whole") & F.col("span").isNotNull())
    if not broken.isEmpty():  # magic inside payloads: read the files concerned again, with their text
        files = broken.select("file").distinct()
        again = _with_offsets(pieces.withColumn("bytes", F.octet_length("value")).join(F.broadcast(files) if files.count() <= BROADCAST_ROWS else files, "file", "left_semi"))
        spans = broken.select("file", "at", F.col("at").alias("record"), "next", "body_at")
        marked = again.join(spans, ["file", "at"], "left")
        order = Window.partitionBy("file").orderBy("at")
        named = marked.select("file", "at", "value", *[F.last(c, True).over(order).alias(c) for c in ("record", "next", "body_at")])
        whole = named.filter("at < next").groupBy("file", "record", "next", "body_at").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        text = F.concat_ws(MAGIC, F.lit(""), F.transform("parts", lambda p: p["value"])).cast("binary")
        content = F.substring(text, (F.col("body_at") + 1).cast("int"), (F.col("next") - F.col("record") - F.col("body_at") - len(GAP)).cast("int"))
        mended = whole.select("file", F.col("record").alias("at"), *[c.alias(n) for c, n in zip(_payload(content), ("h2", "p2", "s2"))])
        records = records.join(mended, ["file", "at"], "left").withColumns({a: F.coalesce(b, a) for a, b in (("http_length", "h2"), ("payload_bytes", "p2"), ("sha1", "s2"))})
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "file",
        "at",
        "record_type",
        "record_id",
        "refers_to",
        F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


@query(
    "op6_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
    FROM d
    """,
)
def op6_warc(spark, folder):
    path = scratch_path(spark, "warc-" + uuid.uuid4().hex[:8])
    write_archives(table(spark, folder, "pages"), path)
    records = read_archives(spark, path)
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
