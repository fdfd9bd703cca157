"""Operator 3, WARC archives with revisit records, read by boundary-chain verification.

Writing: pages of equal payloads (at least LEAST bytes) are found by digest; the
one with the smallest page_id becomes a response record, the others revisit
records without the payload. Spark's text writer puts records into gzip files
of bounded size, with the records' closing blank lines as line separator.

Reading: a task takes an archive's bytes, emits for every place where the
record magic starts a line a candidate with its own offset and that of its
successor, as its header tells it, and looks into no other record. Magic may
also stand inside a payload, so a candidate counts only if the chain of
successors from the file's start reaches it: pointer jumping doubles, per
archive, the reach of every candidate's pointer while it marks what the start
reaches, in logarithmically many steps.

Edge cases: a null html has an empty payload; a null url leaves its header
out, and control characters in it are percent-encoded; a null page_id is never the
page referred to while its copies have ids, and equal pages of null ids alone are all
responses; rows that repeat a page (same id and payload) are all responses or
all revisits. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import scratch_path

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Payload bytes aimed at in one archive; a record is never split.
ARCHIVE = 16 << 20
_PLACE = re.compile(rb"(?:^|(?<=\n))WARC/1\.1\r\n")

FIELDS = "path string, at long, next long, size long, record_type string, page_id long, digest string, payload_bytes long, refers_to long, whole boolean"


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # only digests with several pages matter; a count per digest is made before the shuffle
    first = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def record(decided: DataFrame) -> DataFrame:
    """One column, value: each page's record without its closing blank lines."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    seed = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest").cast("binary"))
    urn = F.regexp_replace(seed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return decided.withColumn("block", block).select(head.alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Gzip archives of about ARCHIVE payload bytes or less below path."""
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    most = min(max(1, ARCHIVE * n // max(total or 0, 1)), 100_000)
    # the rows stay in the tasks that have decided on them: no further shuffle of payloads
    record(decide(pages)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _header(lines: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines.split(b"\r\n")) if v}


def _number(x: bytes | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(rb"-?\d+", x) else None


def candidates(path: str, data: bytes) -> Iterator[tuple]:
    """A row of FIELDS for every place that looks like a record's start."""
    for m in _PLACE.finditer(data):
        top = data.find(b"\r\n\r\n", m.end())
        head = _header(data[m.end() : top]) if top >= 0 else {}
        n = _number(head.get(b"content-length"))
        if n is None or n < 0 or top + 4 + n > len(data):
            yield path, m.start(), None, len(data), "broken", None, None, None, None, False
            continue
        block = memoryview(data)[top + 4 : top + 4 + n]
        mid = data.find(b"\r\n\r\n", top + 4, top + 4 + n)
        http = _header(bytes(block[: mid - top - 4])) if mid >= 0 else {}
        kind = head.get(b"warc-type", b"").decode()
        digest = head.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode()
        if kind == "response":
            payload = block[mid - top :] if mid >= 0 else block
            size, own = len(payload), hashlib.sha256(payload).hexdigest()
            whole, digest = own == digest, own
        else:
            size, whole = _number(http.get(b"content-length")), True
        yield path, m.start(), top + 4 + n + len(END), len(data), kind, _number(head.get(b"x-page-id")), digest, size, _number(head.get(b"x-refers-to-page-id")), whole


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data = content.as_buffer().to_pybytes()
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, 31)
            rows = list(candidates(path, data))
            if rows:
                yield pa.record_batch([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), FIELDS.split(", "), strict=True)], names=names)


def reached(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping.

    at: sorted offsets; following: each one's successor, or -1. After step k a
    pointer leads 2**k records on, and all records up to 2**k after the start are marked.
    """
    n = len(at)
    to = np.minimum(np.searchsorted(at, following), n - 1)
    jump = np.append(np.where((following >= 0) & (at[to] == following), to, n), n)  # n: no further record
    marked = np.zeros(n + 1, bool)
    marked[:n] = at == 0
    while True:
        more = marked.copy()
        more[jump[np.flatnonzero(marked)]] = True
        more[n] = False
        if (more == marked).all():
            return marked[:n]
        marked, jump = more, jump[jump]


def _verify(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at", ignore_index=True)
    return group[reached(group["at"].to_numpy(), group["next"].fillna(-1).to_numpy(np.int64))]


def read(spark, path: str) -> DataFrame:
    """The records of the archives below path, without payloads: FIELDS of those that the chain reaches."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # a group holds one archive's candidates, whose number its size bounds
    return files.mapInArrow(_scan, FIELDS).groupBy("path").applyInPandas(_verify, FIELDS)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and return what they hold, per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    return read(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


#: The same in DuckDB's SQL, for pages.
SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as low from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.low is null or p.page_id is not distinct from f.low then 'response' else 'revisit' end as record_type,
  case when f.low is not null and p.page_id is distinct from f.low then f.low end as refers_to
from p left join f on p.payload_digest = f.payload_digest
"""
