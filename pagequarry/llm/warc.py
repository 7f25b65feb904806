"""WARC archives of pages, and segment reassembly when they are read back.

``write_archives`` makes one record per page: an HTTP response whose body (the
html in UTF-8) is in chunked framing, or a revisit without body where a page with
an equal payload of ``MIN_REVISIT`` bytes or more has a larger page_id. A block
longer than ``SEGMENT`` goes out as a first record and continuation records. The
files are ordinary .warc.gz written by Spark's text writer, each record ended by
two line ends; a file holds at most ``RECORDS_PER_FILE`` records of bounded
length, so a task reads it whole.

``read_archives`` parses the files into records. ``reassemble`` groups
continuations by the origin's identifier, orders them by segment number, checks
that the numbers are complete and the lengths add up to the declared total, and
undoes the chunked framing; records without segments are not shuffled.

Nulls: null html counts as empty; a null url leaves its header out; a null
page_id is written as "null" and never referred to. Rows with equal page_id and
equal html share a record identifier and come back as often as they went in.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import broadcast_if_small, shared_dir, written

MIN_REVISIT = 1000
SEGMENT = 32 * 1024
CHUNK = 8 * 1024
RECORDS_PER_FILE = 1000
#: Most rows of the list of repeated payloads that is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
END = "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cuts(raw: bytes, size: int) -> list[bytes]:
    """raw in pieces of at most ``size`` bytes that end between UTF-8 characters."""
    out, at = [], 0
    while len(raw) - at > size:
        end = at + size
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def chunked(payload: bytes) -> bytes:
    """payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, CHUNK) if c) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions of a chunk's size line and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n" + block.decode()


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, date: str) -> list[str]:
    """The record, or the segments, of one page."""
    payload = (html or "").encode("utf-8", "replace")
    digest = hashlib.sha1(payload).hexdigest()
    name = "null" if page_id is None else str(page_id)
    record_id = f"<urn:page:{name}:{digest}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url is not None else None
    common = [("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Page-ID", name), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), *common, ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record(head, b"")]
    parts = _cuts(HTTP_HEAD + chunked(payload), SEGMENT)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(parts) == 1:
        return [_record(head, parts[0])]
    total = sum(map(len, parts))
    out = [_record([*head, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", total if k == len(parts) else None)
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:{digest}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", k), last], part))
    return out


def write_archives(pages: DataFrame, path: str | None = None, date: str | None = None) -> str:
    """Write pages (page_id, url, html) as archives to a folder that Spark can write, and return the folder.

    Without a path a new folder in the shared one is taken. date is the records'
    WARC-Date (now, in UTC).
    """
    path = path or f"{shared_dir(pages.sparkSession)}/pagequarry/warc-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumns({"k": F.sha2("html", 256), "n": F.octet_length("html")})
    heads = keyed.where(F.col("n") >= MIN_REVISIT).groupBy("k").agg(F.max("page_id").alias("head"), F.count("*").alias("times")).where("times > 1").select("k", "head")
    joined = keyed.join(broadcast_if_small(written(heads, "warc-heads"), BROADCAST_ROWS), "k", "left")
    refers = F.when(F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, html, ref in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                out += page_records(page_id and int(page_id), url, html, ref and int(ref), date)
            yield pd.DataFrame({"value": out}, dtype=object)

    # Ids travel as strings: beside a null, pandas would make floats of them.
    records = joined.select(F.col("page_id").cast("string"), "url", "html", refers.cast("string").alias("refers_to")).mapInPandas(rows, "value string")
    records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)
    return path


RECORD_SCHEMA = "type string, record_id string, page_id long, target_uri string, refers_to string, digest string, origin_id string, segment long, total long, block binary"


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an unpacked archive."""
    at = 0
    while at < len(raw):
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at {at}")
        end = raw.index(b"\r\n\r\n", at)
        headers = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is not as long as it says")
        yield headers, block
        at = end + 8 + size


def unpacked(raw: bytes) -> bytes:
    """The content of a gzip file of any number of members, or raw itself."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out) if out else raw


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                for h, block in parse_records(unpacked(content)):
                    number = lambda k, h=h: h[k] if h.get(k, "null") != "null" else None
                    out.append((h["warc-type"], h["warc-record-id"], number("warc-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    # Numbers travel as strings: beside a null, pandas would make floats of them.
    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, RECORD_SCHEMA.replace("long", "string"))
    return read.withColumns({k: F.col(k).cast("long") for k in ("page_id", "segment", "total")})


@F.pandas_udf(T.BinaryType())
def http_payload(blocks: pd.Series) -> pd.Series:
    """The payload of an HTTP response block, out of its chunked framing where it has one."""

    def payload(block: bytes) -> bytes:
        head, _, body = block.partition(b"\r\n\r\n")
        return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body

    return blocks.map(payload)


def reassemble(records: DataFrame) -> DataFrame:
    """(type, record_id, page_id, target_uri, refers_to, digest, payload): whole responses, and revisits with a null payload.

    A response whose segments are not all there, or do not add up to the total,
    fails the job.
    """
    head = ["type", "record_id", "page_id", "target_uri", "refers_to", "digest"]
    whole = records.where("type = 'response' and segment is null").select(*head, "block")
    revisits = records.where("type = 'revisit'").select(*head, F.lit(None).cast("binary").alias("payload"))
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    firsts = F.max_by(F.struct(*head), F.col("segment") == 1)
    grouped = parts.groupBy("origin").agg(
        firsts.alias("head"), F.count_if(F.col("segment") == 1).alias("times"), F.max("total").alias("total"), F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts")
    )
    complete = (F.get("parts", F.size("parts") - 1)["segment"] == F.size("parts")) & F.expr("aggregate(parts, 0L, (s, x) -> s + octet_length(x.block)) = total") & (F.col("head.type") == "response")
    checked = grouped.withColumn("ok", F.when(F.coalesce(complete, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), F.col("origin"))).cast("boolean")))
    joined = F.expr("aggregate(parts, cast('' as binary), (s, x) -> concat(s, x.block))")
    segmented = checked.where("ok").select("head.*", joined.alias("block"), F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
    return whole.union(segmented).select(*head, http_payload("block").alias("payload")).union(revisits)


def payload_report(payloads: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; a revisit has those of the response that it refers to."""
    light = payloads.select("type", "record_id", "page_id", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    light = written(light, "warc-payloads")
    ok = F.when(F.col("sha") == F.col("digest"), F.col("sha")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("record_id"))))
    responses = light.where("type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), ok.alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    heads = light.where("type = 'response'").groupBy(F.col("record_id").alias("head_id")).agg(F.max("n").alias("head_n"), F.max("sha").alias("head_sha"), F.max("page_id").alias("head_page"))
    revisits = light.where("type = 'revisit'").join(heads, F.col("refers_to") == F.col("head_id"), "left")
    revisits = revisits.select("page_id", F.col("head_n").alias("payload_bytes"), F.col("head_sha").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("head_page").alias("refers_to"))
    return responses.union(revisits)
