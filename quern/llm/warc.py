"""WARC archives without repeated payloads.

Only headers (page, payload digest, length) are shuffled by digest, to find of every group of equal
payloads the page that keeps its payload; the other pages become revisit records that refer to it.
Archives are WARC 1.1 files of about ``FILE_BYTES``, with a gzip member for each record and a warcinfo record
in front, so any record can be read alone.  They are written by Spark's text writer, so tasks commit or repeat as in
any other write: a value is a member without its last byte, which is the top byte of a length below 2^24 and thus
NUL, and NUL is the separator.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import hot_keys, lookup_join, scratch_path, small_batches, table, written

LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_record string, payload string"


def gzip_member(raw: bytes) -> bytes:
    """``raw`` as one gzip member; as several from 16 MB on, so that the last byte of all is NUL."""
    out = []
    for at in range(0, max(1, len(raw)), 1 << 23):
        part = raw[at : at + (1 << 23)]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        out += [b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff", deflate.compress(part), deflate.flush(), struct.pack("<II", zlib.crc32(part), len(part))]
    return b"".join(out)


def gunzipped(raw, step: int = 1 << 16):
    """The content of each gzip member of ``raw``."""
    view, at = memoryview(raw), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a gzip member")
            parts.append(inflate.decompress(view[at : at + step]))
            at += min(step, len(view) - at) - len(inflate.unused_data)
        yield b"".join(parts)


def _record_id(page: Column, digest: Column) -> Column:
    """A name-based id: pages of equal id and payload have equal records."""
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4))] + [F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _payload(html_col: str) -> Column:
    return F.coalesce(F.col(html_col), F.lit(""))


def revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, original, original_url) of every page whose payload another page keeps.

    Of equal payloads of at least ``least_bytes`` bytes, the page with the largest id keeps it.
    """
    heads = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.sha1(_payload(html_col).cast("binary")).alias("digest"),
        F.octet_length(_payload(html_col)).alias("bytes"),
    )
    heads = written(heads.where(F.col("bytes") >= least_bytes).where("page_id is not null"), "warc-heads")
    kept = heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("n"))
    kept = written(kept.where("n > 1"), "warc-originals")
    found = lookup_join(heads, kept, "digest", hot=hot_keys(kept, "digest"))
    return found.where("page_id < original").select("page_id", "digest", "original", "original_url").distinct()


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_REVISIT_BYTES,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Writes one record per row of ``pages``, with fresh headers, to files of about ``file_bytes``.

    If the revisits are too many to broadcast, pages are shuffled once by id and digest to meet them.

    Cases: null html is an empty payload, a null url leaves out its header, and a row with a null id
    keeps its payload.  Rows of equal id and payload get equal records.  Line ends in urls become
    blanks.  Very long pages are records like any others.  Other columns are ignored; an empty input writes no record.
    """
    found = written(revisits(pages, id_col=id_col, url_col=url_col, html_col=html_col, least_bytes=least_bytes), "warc-revisits")
    found = found.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "original", "original_url")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), _payload(html_col).alias("html"), F.sha1(_payload(html_col).cast("binary")).alias("digest")
    ).join(found, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")

    revisit = F.col("original").isNotNull()
    one_line = lambda c: F.regexp_replace(c, "[\r\n]+", " ")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = rows.select("*", block.alias("block")).select(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            F.concat(F.lit("WARC-Record-ID: <"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">")),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Target-URI: "), one_line(F.col("url"))),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _record_id(F.col("original"), F.col("digest")), F.lit(">"))),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), one_line(F.col("original_url")))),
            F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n")),
            F.col("block"),
        ).alias("value")
    )
    fields = "software: quern\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{{}}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}{fields}{END}"

    def compress(batches):
        from pyspark import TaskContext

        part, file, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            files, values = [], []
            for value in b.column(0):
                if size >= file_bytes:
                    file, size = file + 1, 0
                if not size:
                    name = hashlib.md5(f"{path}|{part}|{file}".encode()).hexdigest()
                    urn = f"urn:uuid:{name[:8]}-{name[8:12]}-8{name[13:16]}-a{name[17:20]}-{name[20:]}"
                    files.append(file)
                    values.append(gzip_member(info.format(urn).encode())[:-1])
                    size += len(values[-1])
                files.append(file)
                values.append(gzip_member(value.as_py().encode() + END.encode())[:-1])
                size += len(values[-1])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(values, pa.binary())], names=["file", "value"])

    members = small_batches(record).mapInArrow(compress, "file int, value binary")
    members.select("file", F.col("value").cast("string")).write.option("lineSep", "\0").partitionBy("file").text(path)


def parse_records(parts):
    """(headers in lower case, block) of each record of an uncompressed archive, given in parts."""
    held = b""
    for part in parts:
        held, at = held + part if held else part, 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record where one should begin")
            headers = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
            stop = end + 4 + int(headers["content-length"])
            if stop + 4 > len(held):
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record isn't closed")
            yield headers, held[end + 4 : stop]
            at = stop + 4
        held = held[at:]
    if held:
        raise ValueError("an archive ends within a record")


def _hex(digest: str) -> str:
    """A sha1 digest in hexadecimal, whether it was written so or in base 32."""
    value = digest.removeprefix("sha1:")
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def _row(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, payload = h["warc-type"], None
    digest = _hex(h["warc-payload-digest"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
    page = h.get("warc-page-id")
    return (
        h["warc-record-id"].strip("<>"),
        None if page is None else int(page),
        h.get("warc-target-uri"),
        kind,
        None if payload is None else len(payload),
        digest,
        h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
        payload.decode("utf-8") if with_payload and payload is not None else None,
    )


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives under ``path``; revisit records have a null payload and length.

    The digest of every payload is computed anew and must equal that in the headers.  Archives may be
    uncompressed, or gzipped with whole records in each member or in the whole file; records are unpacked one after
    the other, and rows leave in batches of about ``BATCH_BYTES``.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_buffer()
                rows, size = [], 0
                for h, block in parse_records(gunzipped(raw) if raw[:2].to_pybytes() == b"\x1f\x8b" else [raw.to_pybytes()]):
                    if h["warc-type"] in ("response", "revisit"):
                        rows.append(_row(h, block, with_payload))
                        size += len(block) if with_payload else 0
                        if size >= BATCH_BYTES or len(rows) >= 4096:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with each revisit's length (and payload) taken from the response that it refers to, as ``original``."""
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_record"))
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("o_bytes"), F.first("payload").alias("o_payload"))
    )
    return records.join(originals, "refers_to_record", "left").select(
        "record_id",
        "page_id",
        "url",
        F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        F.coalesce("payload", "o_payload").alias("payload"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = written(read_warc(spark, path, with_payload=False), "warc-records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN strlen(html) >= {LEAST_REVISIT_BYTES} AND page_id < max(page_id) OVER (PARTITION BY html)
      THEN max(page_id) OVER (PARTITION BY html) END AS refers_to
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""
