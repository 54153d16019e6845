import os
import textwrap

import pytest

from quern.llm import licenses
from quern.llm.common import table

SCHEMA = "doc_id long, text string, name string, digest string, whole string"


def scan(spark, rows):
    return licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()


def test_whole_texts_in_any_spelling(spark):
    mit = dict(licenses.LICENSE_TEXTS[:1])["MIT"]
    odd = "  Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace('"', "'").replace(" ", "  ")
    rows = [(1, mit, None, None, None), (2, odd, "a", "b", "c"), (3, mit + " and more", None, None, None), (4, "MIT", None, None, None)]
    assert {r.doc_id: r.license_id for r in scan(spark, rows)} == {1: "MIT", 2: "MIT", 3: None, 4: None}


def test_every_known_text_is_found(spark):
    rows = [(i, text, None, None, None) for i, (_, text) in enumerate(licenses.LICENSE_TEXTS)]
    assert {r.doc_id: r.license_id for r in scan(spark, rows)} == {i: n for i, (n, _) in enumerate(licenses.LICENSE_TEXTS)}


def test_notices(spark):
    text = "Some text.\nReleased under the MIT License.\nmore\n  RELEASED UNDER THE MIT LICENCE\nLicensed under CC BY-NC 4.0.\nI released under the MIT License"
    (row,) = scan(spark, [(1, text, None, None, None)])
    assert (row.notices, row.notice_lines, row.license_id) == ("CC-BY-NC-4.0|MIT", 3, None)


def test_edge_cases(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (None, "a B", None, None, None), (3, "a b!", None, None, None), (3, "a b!", None, None, None), (4, "Copyright 2020 Me\n", None, None, None), (5, "x y\n" * 50_000, None, None, None)]
    got = scan(spark, rows)
    assert len(got) == len(rows)
    digests = {r.doc_id: r.text_digest for r in got}
    assert digests[1] == digests[2] == digests[4] == licenses.plain_digest("")
    assert digests[None] == digests[3] == licenses.plain_digest("A b")
    assert scan(spark, []) == []


def test_columns_equal_plain_python(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in licenses.op1_licenses(spark, sf_dir).collect():
        assert r.text_digest == licenses.plain_digest(texts[r.doc_id])


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_line_ends_do_not_matter():
    """Every known text, wrapped at every width, with a copyright line before it."""
    for name, text in licenses.LICENSE_TEXTS:
        for width in range(40, 121):
            assert licenses.plain_digest("Copyright (c) 2019-2021 A Person\nAll rights reserved.\n\n" + wrapped(text, width)) == licenses.plain_digest(text), (name, width)


FILES = "/usr/share/common-licenses/"
long_texts = pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence files here")
NAMES = {"Apache-2.0": "Apache-2.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic-1.0": "Artistic"}


@long_texts
def test_long_licences_alone_and_within_texts(spark):
    texts = {name: open(FILES + file, encoding="utf-8").read() for name, file in NAMES.items()}
    rows = [(name, t.upper().replace("\n", "\r\n")) for name, t in texts.items()]
    rows += [(f"in {name}", "A program.\n\nCopyright 2020 Someone\n\n" + wrapped(t, 40 + 3 * i) + "\n\nmore words after it") for i, (name, t) in enumerate(texts.items())]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name in NAMES:
        assert got[name].license_id == name and name in got[name].contained.split("|")
        assert got[f"in {name}"].license_id is None and name in got[f"in {name}"].contained.split("|")


def test_short_licences_within_texts_and_sql(spark):
    """Planted documents, in Spark and in DuckDB."""
    import duckdb
    import pandas as pd

    by_name = {n: t for n, t in licenses.LICENSE_TEXTS}
    rows = [(i, wrapped(t, 40 + 7 * i)) for i, (_, t) in enumerate(licenses.LICENSE_TEXTS)]
    rows += [(100, "#!/bin/sh\n\n" + by_name["MIT"] + "\n\nlicensed under the MPL 2.0\n" + by_name["Zlib"]), (101, None), (102, by_name["MIT"][:-20]), (103, "Sub\nlicence, non\n\ninfringement"), (104, "sublicense noninfringement")]
    got = sorted(map(tuple, licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert got == sorted(tuple(r) for r in duckdb.sql(licenses.oracle()).fetchall())
    assert [r[2] for r in got[: len(licenses.LICENSE_TEXTS)]] == [n for n, _ in licenses.LICENSE_TEXTS]
    found = {r[0]: r for r in got}
    assert found[100][3:] == ("MIT|Zlib", "MPL-2.0", 1) and found[102][2:4] == (None, "") and found[103][1] == found[104][1]


def test_full_texts_of_the_caller(spark):
    text = "This text of thirteen words is a licence that only the caller knows about."
    rows = [(1, text.upper()), (2, text + " Or not."), (3, "Before, " + text)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), texts=[("Own-1.0", text)]).collect()
    assert {r.doc_id: (r.license_id, r.contained) for r in found} == {1: ("Own-1.0", "Own-1.0"), 2: (None, "Own-1.0"), 3: (None, "Own-1.0")}
