"""WARC archives with revisit records.

Pages become WARC records: one response for each payload, and revisit records
that refer to it for the pages that repeat it.  Only headers are shuffled by
payload digest.  Each record is a gzip member of its own, each file begins
with a warcinfo record and holds about FILE_BYTES bytes, so that files can be
read whole, one a task, and records one at a time.  Spark's text writer writes
the bytes as they are, to any file system that Spark writes to; what it puts
after the one row of a file is an empty gzip member.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialise, new_path
from ..sources import files
from .columns import few

#: A key is hot with over LEAST rows and one in SHARE of all; so there are under SHARE hot keys.  Their rows are dealt to SALTS parts.
LEAST, SHARE, SALTS = 10_000, 10_000, 64
SMALLEST, DATE = 1000, "2020-01-01T00:00:00Z"
#: Compressed bytes of a file (and one record more); rows sent to Python at once, which may be large.
FILE_BYTES, ROWS = 16 << 20, 256
_END = "\r\n"
_NOTHING = gzip.compress(b"", mtime=0)
_INFO = "software: driftmark\r\nformat: WARC File Format 1.1\r\n"
_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def headers(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to and refers_url for every row of ``pages``.

    A null html is an empty payload.  Among rows with equal payloads of at
    least ``smallest`` bytes the one with the largest page_id (null is below
    all others; of repeated ids one row) is the response.  Payloads stay where
    they are while the revisits are few enough to be sent to all executors.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    large = materialise(large, "headers")
    shared = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("all")).where("`all` > 1")
    shared = materialise(shared.select("payload_digest", F.col("all").alias("rows"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")), "shared")
    kind = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), "revisit").when(F.col("n") > 1, "repeated")
    known = by_digest(large.drop("url"), shared, "rows").select(F.col("payload_digest").alias("_digest"), F.col("page_id").alias("_page"), "refers_to", "refers_url", kind.alias("record_type")).where("record_type is not null")
    known = few(materialise(known, "revisits"))
    marked = rows.join(known, (rows["payload_digest"] == known["_digest"]) & rows["page_id"].eqNullSafe(known["_page"]), "left").drop("_digest", "_page")
    if known.where("record_type = 'repeated'").isEmpty():
        return marked.withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    # rows that repeat id and payload: the first of them, once their numbers are frozen, is the response
    again = materialise(marked.where("record_type = 'repeated'").withColumn("row", F.monotonically_increasing_id()), "repeated")
    first = materialise(again.groupBy("payload_digest").agg(F.min("row").alias("first"), F.count("*").alias("rows")), "first")
    again = by_digest(again, first, "rows").withColumn("record_type", F.when(F.col("row") == F.col("first"), "response").otherwise("revisit"))
    again = again.withColumns({c: F.when(F.col("record_type") == "revisit", F.col(c)) for c in ("refers_to", "refers_url")}).select(marked.columns)
    rest = marked.where("record_type is null or record_type = 'revisit'").withColumn("record_type", F.coalesce("record_type", F.lit("response")))
    return rest.unionByName(again)


def by_digest(rows: DataFrame, facts: DataFrame, n: str) -> DataFrame:
    """``rows`` with their digest's row of ``facts``, whose column ``n`` (left out) says how many rows the digest has.

    Facts that are few enough go to all executors.  Else both sides shuffle
    by digest, but the rows of hot digests, which are under SHARE by their
    definition, are dealt to SALTS parts beside copies of their facts.
    """
    sent = few(facts)
    if sent is not facts:
        return rows.join(sent.drop(n), "payload_digest")
    total = facts.agg(F.sum(n)).first()[0]
    often = F.col(n) > max(LEAST, total / SHARE)
    hot = F.broadcast(facts.where(often).select("payload_digest", F.lit(True).alias("_hot")))
    salted = rows.join(hot, "payload_digest", "left").withColumn("_salt", F.when(F.col("_hot"), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(0).cast("long"))).drop("_hot")
    copies = F.when(often, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(facts.withColumn("_salt", F.explode(copies)).drop(n), ["payload_digest", "_salt"]).drop("_salt")


def _urn(*parts: Column) -> Column:
    key = F.sha2(F.concat_ws("/", *parts), 256)
    uuid = F.concat_ws("-", F.substring(key, 1, 8), F.substring(key, 9, 4), F.concat(F.lit("5"), F.substring(key, 14, 3)), F.concat(F.lit("8"), F.substring(key, 18, 3)), F.substring(key, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _record(record_date: str, smallest: int) -> Column:
    """A record's text, with fresh headers.

    The id of a response that others may refer to follows from its page and
    payload; other ids from their place in the input too.
    """
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("unknown:")), "[\\x00-\\x20\\x7F]", "%20")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    revisit = F.col("record_type") == "revisit"
    shared = ~revisit & (F.col("payload_bytes") >= smallest)
    own = F.when(shared, _urn(text("page_id"), F.col("payload_digest"))).otherwise(_urn(text("page_id"), F.col("payload_digest"), F.monotonically_increasing_id().cast("string")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END + _END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), own),
        F.lit(f"WARC-Date: {record_date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(text("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), clean(F.col("refers_url")))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {record_date}")),
        F.when(revisit & F.col("refers_to").isNotNull(), F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(_END, *lines), F.lit(_END + _END), block, F.lit(_END + _END))


def _files(batches: Iterator[pa.RecordBatch], record_date: str, most: int) -> Iterator[pa.RecordBatch]:
    """Whole files from records: a warcinfo member, then members up to about ``most`` bytes."""
    held, size, made = [], 0, 0

    def whole() -> pa.RecordBatch:
        name = hashlib.sha1(held[0][-4096:] + str(made).encode()).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-8{name[17:20]}-{name[20:32]}>\r\nWARC-Date: {record_date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(_INFO)}\r\n\r\n{_INFO}\r\n\r\n"
        return pa.RecordBatch.from_arrays([pa.array([b"".join([gzip.compress(head.encode(), mtime=0), *held])], pa.binary())], ["value"])

    for batch in batches:
        for record in batch.column(0):
            held.append(gzip.compress(record.as_buffer(), compresslevel=6, mtime=0))
            size += len(held[-1])
            if size >= most:
                yield whole()
                held, size, made = [], 0, made + 1
    if held:
        yield whole()


def write(pages: DataFrame, path: str, record_date: str = DATE, smallest: int = SMALLEST, file_bytes: int = FILE_BYTES) -> None:
    """Write deduplicated archives of ``pages`` (page_id, url, html) to the folder ``path``, as *.warc.gz."""
    spark = pages.sparkSession
    records = headers(pages, smallest).select(_record(record_date, smallest).cast("binary").alias("value"))
    whole = records.mapInArrow(lambda it: _files(it, record_date, file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(min(ROWS, int(before))) if int(before) > 0 else str(ROWS))
    try:
        whole.write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)
    finally:
        spark.conf.set(rows, before)
    files.renamed(spark, path, ".txt", ".warc.gz")


def _members(raw: memoryview) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one at a time."""
    at = 0
    while at < len(raw):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(raw):
                raise ValueError("the file ends inside a gzip member")
            chunk = raw[at : at + (1 << 16)]
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        yield b"".join(parts)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out, size = _columns(), 0
            for raw in _members(memoryview(content.as_buffer())):
                at = 0
                while at < len(raw):  # members of other writers may hold several records
                    at = _take(raw, at, out)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield _batch(out)
                    out, size = _columns(), 0
            yield _batch(out)


_NAMES = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")


def _columns() -> dict[str, list]:
    return {name: [] for name in _NAMES}


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(_NAMES, kinds, strict=True)], list(_NAMES))


def _take(raw: bytes, at: int, out: dict[str, list]) -> int:
    """Read the record at a place into columns (a warcinfo into none); the place after it."""
    stop = raw.index(b"\r\n\r\n", at)
    first, *lines = raw[at:stop].decode().split(_END)
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    end = stop + 4 + int(head["content-length"])
    if head["warc-type"] not in ("response", "revisit"):
        return end + 4
    body = raw.index(b"\r\n\r\n", stop + 4) + 4
    http = {k.lower(): v for k, _, v in (line.partition(b": ") for line in raw[stop + 4 : body - 4].split(b"\r\n"))}
    digest = head["warc-payload-digest"].partition(":")[2]
    payload = raw[body:end] if head["warc-type"] == "response" else None
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest differs in record {head['warc-record-id']}")
    found = {
        "page_id": int(head["x-page-id"]) if "x-page-id" in head else None, "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
        "payload_bytes": int(http[b"content-length"]), "payload_digest": digest, "refers_to": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None, "payload": payload,
    }
    for name, value in found.items():
        out[name].append(value)
    return end + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``; the payload of a revisit is null.  A digest that doesn't fit is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(_parsed, _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits taken from the responses with the same digest; null where there is none."""
    full = records.where("record_type = 'response'")
    repeated = records.where("record_type = 'revisit'").drop("payload")
    wanted = materialise(repeated.groupBy("payload_digest").agg(F.count("*").alias("rows")), "wanted")
    originals = full.join(wanted, "payload_digest").groupBy("payload_digest").agg(F.first("payload").alias("payload"), F.first("rows").alias("rows"))
    originals = materialise(wanted.select("payload_digest").join(originals, "payload_digest", "left").withColumn("rows", F.coalesce("rows", F.lit(1))), "originals")
    return full.unionByName(by_digest(repeated, originals, "rows").select(*full.columns))


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what is read back from them.

    Any page with an empty or null html is a response with an empty payload;
    an empty table gives no archive and no record.
    """
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
