import gzip
import hashlib

import duckdb

from quern.llm import warc
from quern.llm.common import scratch_path, table

SCHEMA = "page_id long, url string, html string, digest string, original long, value string"


def plain(rows, least=1000):
    best = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= least:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        other = best.get(h) if h and i is not None and best.get(h, i) > i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other is not None else "response", other))
    return sorted(out, key=str)


def round_trip(spark, rows):
    path = scratch_path(spark, "test")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), path, file_bytes=2000)
    return path, warc.resolve(warc.read_warc(spark, path))


def test_op9_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op9_warc(spark, sf_dir).collect()), key=str) == plain(rows)


def test_edge_cases_and_payloads(spark):
    big = "<p>é WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n</p>" * 60
    rows = [
        (1, "http://a/", big, None, None, None), (2, None, big, "x", 1, "y"), (5, "http://a/\r\nX: y", big, None, None, None),
        (3, "http://b/", None, None, None, None), (4, "http://b/", "", None, None, None), (6, "u", "small", None, None, None),
        (7, "u", "small", None, None, None), (None, "http://c/", big, None, None, None), (8, "", "x" * 999, None, None, None),
        (9, "", "x" * 999, None, None, None), (10, "u", "y" * 2_000_000, None, None, None), (11, "u", "y" * 2_000_000, None, None, None),
        (11, "u", "y" * 2_000_000, None, None, None),
    ]
    path, found = round_trip(spark, rows)
    got = found.collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == plain(rows)
    texts = {r[0]: r[2] or "" for r in rows}
    assert all(r.payload == texts[r.page_id] for r in got)
    raw = [f.content for f in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert len(raw) >= 3
    for content in raw:
        members = list(warc.gunzipped(content))
        assert b"".join(members) == gzip.decompress(content)
        kinds = [h["warc-type"] for m in members for h, _ in warc.parse_records([m])]  # a record each
        assert len(kinds) == len(members) and kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
    for headers, _ in warc.parse_records(map(gzip.decompress, raw)):
        assert headers["warc-record-id"].startswith("<urn:uuid:") and "x" not in headers
    assert round_trip(spark, [])[1].count() == 0


def test_members_of_long_records():
    raw = bytes(range(256)) * (1 << 17)
    member = warc.gzip_member(raw)
    assert member[-1] == 0 and gzip.decompress(member) == raw == b"".join(warc.gunzipped(member)) and gzip.decompress(warc.gzip_member(b"")) == b""


def test_base32_digests_are_read():
    raw = hashlib.sha1(b"x")
    import base64

    assert warc._hex("sha1:" + base64.b32encode(raw.digest()).decode()) == raw.hexdigest()


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(con.execute(warc.ORACLE).fetchall(), key=str) == sorted(map(tuple, warc.op9_warc(spark, sf_dir).collect()), key=str)
