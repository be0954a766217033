"""WARC archives: writing pages as records, and reading them back with segment reassembly.

A record whose block is longer than one segment is written as a first segment and continuation
records that name it as their origin. Reading parses each archive by content lengths, groups
continuation records by origin, orders them by segment number, checks that they are complete
and as long as the last one says, and takes the chunked transfer framing off the payload. Only
segmented records are shuffled; whole ones are finished where their archive is read.
"""

import base64
import datetime as dt
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from mailgrid.llm.common import remove_folder
from mailgrid.operators.relational import hot_join
from mailgrid.session import checkpointed, work_folder

VERSION = b"WARC/1.1\r\n"
SEGMENT = 16 * 1024
CHUNK = 4096
# Records of one archive at most, so that a reader can hold an archive in memory.
RECORDS = 5000
# Payloads below this size are always written in full.
REVISIT_FROM = 1000
# Fixed value: the profile of a revisit whose payload has the digest of the response's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
EPOCH = "1970-01-01T00:00:00Z"


def cuts(data, size):
    """Slices of about ``size`` bytes that do not split a UTF-8 character."""
    at = 0
    while at < len(data):
        end = at + size
        while at + size - end < 3 and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload):
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in cuts(payload, CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body):
    """The payload of chunked framing; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def record(headers, block):
    """A record without its very last byte, a line feed, which the text writer adds."""
    lines = b"".join(b"%b: %b\r\n" % (k.encode(), str(v).encode()) for k, v in headers)
    return b"%b%bContent-Length: %d\r\n\r\n%b\r\n\r" % (VERSION, lines, len(block), block)


def response_id(page_id, digest):
    """The id of a page's response, which revisits can name without having seen it."""
    return f"<urn:page:{page_id}:{digest}>"


def page_records(number, page_id, url, payload, digest, refers_to, date=EPOCH):
    """All records of a page. Header values cannot hold line breaks, so a URL is quoted.

    ``number`` tells repeated rows apart: they have the same id, as they are the same record,
    but each comes back on its own.
    """
    headers = [("WARC-Date", date), ("WARC-Page-Copy", number)]
    if page_id is not None:
        headers.append(("WARC-Page-ID", page_id))
    if url is not None:
        safe = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url)
        headers.append(("WARC-Target-URI", safe))
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    headers += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", HTTP)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        extra = [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:revisit:{page_id}:{number}>"),
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(refers_to, digest)),
        ]
        return [record(extra + headers, block)]
    name = f"<urn:page::{number}>" if page_id is None else response_id(page_id, digest)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *headers]
    if len(block) <= SEGMENT:
        return [record(first, block)]
    parts = list(cuts(block, SEGMENT))
    out = [record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        extra = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"{name[:-1]}:{n}>"),
            ("WARC-Date", date),
            ("WARC-Page-Copy", number),
            ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", n),
        ]
        if n == len(parts):
            extra.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record(extra, part))
    return out


def with_roles(pages, key, html):
    """Adds payload digest and ``refers_to`` to the pages.

    Of equal payloads of at least 1000 bytes the one with the largest key is the response, the
    others refer to it. Keys combine before the shuffle, and the join can split a frequent
    payload.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    sized = pages.withColumn("_payload", body).withColumn("_digest", F.sha1("_payload"))
    many = checkpointed(
        sized.filter(F.octet_length("_payload") >= REVISIT_FROM)
        .groupBy("_digest")
        .agg(F.max(key).alias("_top"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = hot_join(sized, many, ["_digest"], "left")
    other = F.col("_top").isNotNull() & ~F.col(key).eqNullSafe(F.col("_top"))
    return joined.withColumn("_refers", F.when(other, F.col("_top").cast("string")))


def write_archives(pages, folder, key="page_id", url="url", html="html"):
    """Writes one record per page into gzip archives below ``folder``; their date is now."""
    date = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    columns = pages.select(
        F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"),
        F.col(html).alias("_html"),
    )
    rows = with_roles(columns, "_key", "_html").select(
        F.col("_key").cast("string"), "_url", "_payload", "_digest", "_refers",
        F.spark_partition_id().alias("_part"),
    )

    def run(batches):
        number = 0
        for batch in batches:
            out = []
            for page, address, payload, digest, refers, part in zip(
                *(c.to_pylist() for c in batch.columns)
            ):
                number += 1
                out += page_records(
                    f"{part}-{number}", page, address, payload.encode(), digest, refers, date
                )
            yield pa.RecordBatch.from_arrays([pa.array([r.decode() for r in out], pa.string())], ["value"])

    (
        rows.mapInArrow(run, "value string")
        .write.option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS)
        .text(folder)
    )


def parse_archive(data):
    """(headers with lower-case names, block) of every record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        begin = head + 4
        end = begin + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, data[begin:end]
        at = end + 4


RESULT = [
    ("record", pa.string()), ("page", pa.string()), ("record_type", pa.string()),
    ("refers_record", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()),
    ("payload", pa.string()),
]
SEGMENTS = [
    ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
    ("block", pa.binary()),
]
RESULT_DDL = (
    "record string, page string, record_type string, refers_record string, payload_bytes long,"
    " payload_digest string, status string, payload string"
)
SHOWN = [
    "page", "record_type", "refers", "payload_bytes", "payload_digest", "status", "payload",
]
SEGMENTS_DDL = "origin string, number int, total long, block binary"


def finished(headers, block, keep):
    """The result row of one complete record."""
    head, _, body = block.partition(b"\r\n\r\n")
    digest = headers.get("warc-payload-digest", "")
    said = base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None
    kind = headers.get("warc-type")
    named = headers.get("warc-record-id"), headers.get("warc-page-id"), kind
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        refers = headers.get("warc-refers-to")
        return *named, refers, int(size[1]) if size else None, said, "ok", None
    try:
        if re.search(rb"(?im)^transfer-encoding:\s*chunked", head):
            body = unchunked(body)
    except ValueError:
        return *named, None, None, None, "broken chunks", None
    found = hashlib.sha1(body).hexdigest()
    status = "ok" if said in (None, found) else "wrong digest"
    text = body.decode("utf-8", "replace") if keep else None
    return *named, None, len(body), found, status, text


def reassembled(parts, keep):
    """The result row of the segments (number, total length, headers, block) of one record."""
    parts = sorted({p[0]: p for p in parts}.values())
    headers, total = parts[0][2], parts[-1][1]
    names = ("warc-record-id", "warc-page-id", "warc-type")
    failed = *map(headers.get, names), None, None, None
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
        return *failed, "missing segment", None
    block = b"".join(p[3] for p in parts)
    if len(block) != total:
        return *failed, "wrong length", None
    return finished(headers, block, keep)


def resolved(rows, responses):
    """The rows with ``refers``, the page of a revisit's response, found by its record id; a
    revisit without one has the status ``no response``."""
    heads = responses.groupBy("record").agg(F.min("page").alias("_page"))
    heads = heads.select(F.col("record").alias("refers_record"), "_page", F.lit(True).alias("_is"))
    found = hot_join(rows.filter("record_type = 'revisit'"), heads, ["refers_record"], "left")
    status = F.when(F.col("_is"), F.col("status")).otherwise("no response")
    revisits = found.withColumn("status", status).withColumn("refers", F.col("_page"))
    others = rows.filter("record_type is distinct from 'revisit'")
    return revisits.select(*SHOWN).unionByName(without_reference(others))


def without_reference(rows):
    return rows.withColumn("refers", F.lit(None).cast("string")).select(*SHOWN)


def read_archives(spark, folder, keep_payload=True):
    """One row per record: page, record_type, refers, payload_bytes, payload_digest (hex SHA-1),
    status, payload.

    status is ``ok``, or ``missing segment``, ``wrong length``, ``broken chunks``, ``wrong
    digest``, or ``no response`` for a revisit whose response is not there; a record that cannot
    be put together has no payload. Segments that come twice count once. A folder without
    archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.col("length") > 0).select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for headers, block in parse_archive(data):
                    if "warc-segment-number" in headers:
                        origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                        origin += headers.get("warc-page-copy", "")
                        total = headers.get("warc-segment-total-length")
                        lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
                        rows.append((
                            headers["warc-record-id"], headers.get("warc-page-id"),
                            headers.get("warc-type"), *(None,) * (len(RESULT) - 3), origin, int(headers["warc-segment-number"]),
                            int(total) if total else None, lines.encode() + b"\r\n" + block,
                        ))
                    else:
                        rows.append((*finished(headers, block, keep_payload), *(None,) * 4))
                    if len(rows) == 1000:
                        yield batch_of(rows, RESULT + SEGMENTS)
                        rows = []
                yield batch_of(rows, RESULT + SEGMENTS)

    parsed = checkpointed(files.mapInArrow(parse, f"{RESULT_DDL}, {SEGMENTS_DDL}"))

    def join(table):
        parts = []
        for _, number, total, block in zip(*(c.to_pylist() for c in table.columns)):
            head, _, rest = block.partition(b"\r\n\r\n")
            pairs = (line.partition(": ") for line in head.decode().split("\r\n"))
            parts.append((number, total, {k: v for k, _, v in pairs}, rest))
        row = reassembled(parts, keep_payload)
        return pa.Table.from_batches([batch_of([row], RESULT)])

    whole = parsed.filter(F.col("origin").isNull()).select(*[n for n, _ in RESULT])
    split = parsed.filter(F.col("origin").isNotNull()).select(*[n for n, _ in SEGMENTS])
    joined = split.groupBy("origin").applyInArrow(join, RESULT_DDL)
    # Whole records and first segments.
    responses = parsed.filter("record_type = 'response'").select("record", "page")
    return resolved(whole, responses).unionByName(without_reference(joined))


def batch_of(rows, fields):
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields]
    )


def archive_round_trip(pages, key="page_id", url="url", html="html"):
    """Writes the pages to archives and reads them back: key, payload_bytes, payload_digest,
    record_type, refers_to, status.

    NULL html is an empty payload. Pages that repeat the key and payload of the response are
    responses too; if all keys of equal payloads are NULL, none of them is a revisit. The
    archives are removed once the result is kept.
    """
    spark = pages.sparkSession
    folder = work_folder(spark, "warc")
    write_archives(pages, folder, key, url, html)
    kind = pages.schema[key].dataType
    read = checkpointed(
        read_archives(spark, folder, keep_payload=False).select(
            F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest",
            "record_type", F.col("refers").cast(kind).alias("refers_to"), "status",
        )
    )
    remove_folder(spark, folder)
    return read
