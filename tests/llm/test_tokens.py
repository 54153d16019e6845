import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm import bpe, packing, token_files
from quern.llm.common import scratch_path, table

SCHEMA = "doc_id long, text string, lang string, n_tokens string, start string, part string"
ROWS = [
    (5, "Hello world, it's <|endoftext|> fine", "en", "x", "y", "z"),
    (1, None, None, None, None, None),
    (2, "", "en", "x", "y", "z"),
    (2, "same id", "en", "x", "y", "z"),
    (2, "same id", "en", "x", "y", "z"),
    (None, "no id  \n\n  tail ", "en", "x", "y", "z"),
    (9, "long " * 30_000, "en", "x", "y", "z"),
    (7, "Ünïcode 漢字 ٣٤   ‘q’", "en", "x", "y", "z"),
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memo_equals_library(spark, sf_dir, plain):
    texts = [r.text or "" for r in table(spark, sf_dir, "documents").select("text").collect()] + [r[1] or "" for r in ROWS]
    assert [x.tolist() for x in bpe.encoder(bpe.default_path())(texts)] == [plain(t) for t in texts]


def test_mixed_white_space_equals_library(plain):
    rng = random.Random(3)
    texts = ["a\tb c  d", "a\tb c d ", "a\u00a0b c  d", "a\x0bb\n\nc", " \ta b", "a\tb c\n\n\nd", "a\x1cb  c", "\u3000", " ", "\n"]
    gaps = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\t", "\r\n", "\u00a0", "\x0b", "\x1f", "\x85", "\u2003", "\u2028"]
    for _ in range(600):
        words = [rng.choice(["a", "it's", "word,", "漢字", "7", "(x)"]) for _ in range(rng.randrange(1, 7))]
        texts.append("".join(w + rng.choice(gaps) for w in words).removesuffix(" "))
    # alone, so that one text can't hide in the batch of another, and all together
    own = bpe.Encoder(bpe.default_path())
    want = [plain(t) for t in texts]
    assert [own([t])[0].tolist() for t in texts] == want
    assert [x.tolist() for x in own(texts)] == want


def expected_token_rows(rows, plain):
    out, start = [], 0
    for key, text in rows:
        ids = plain(text) + [2]
        out.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_op6_equals_plain_loop(spark, sf_dir, plain):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    assert sorted(map(tuple, token_files.op6_token_files(spark, sf_dir).collect())) == expected_token_rows(docs, plain)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_edge_cases(spark, plain, encoding):
    path = scratch_path(spark, "test")
    token_files.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path, encoding=encoding)
    got = sorted(map(tuple, token_files.token_file_digests(spark, path).collect()), key=lambda r: r[1])
    ordered = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: -1 if r[0] is None else r[0])
    assert got == expected_token_rows(ordered, plain)
    some = token_files.read_token_files(spark, path, ids=(5, 7), columns=["doc_id", "n_tokens"])
    assert sorted(r.doc_id for r in some.collect()) == [5, 7]


def test_token_files_empty(spark):
    path = scratch_path(spark, "test")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path)
    assert token_files.token_file_digests(spark, path).count() == 0


def test_token_files_use_the_asked_encodings(spark):
    import glob

    import pyarrow.parquet as pq

    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = scratch_path(spark, "test")
        token_files.write_token_files(spark.createDataFrame(ROWS, SCHEMA), path, encoding=encoding)
        local = path.removeprefix("file:").replace("///", "/")
        columns = [
            c
            for f in glob.glob(f"{local}/*.parquet")
            for g in range(pq.ParquetFile(f).metadata.num_row_groups)
            for c in [pq.ParquetFile(f).metadata.row_group(g).column(4)]
        ]
        assert columns and all(name in c.encodings and c.has_column_index for c in columns)


def check_pieces(rows, docs, plain, window=2048):
    ids = {k: plain(t) + [1] for k, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == len(ids[key])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_op10_covers_every_id_once(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert check_pieces(packing.op10_pack(spark, sf_dir).collect(), docs, plain) == 0


def test_pack_edge_cases(spark, plain):
    rows = [r for r in ROWS if r[0] != 2] + [ROWS[2]]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert check_pieces(packing.pack(docs).collect(), [(r[0], r[1]) for r in rows], plain) == 0
    repeated = packing.pack(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sum(r.length for r in repeated) == sum(len(plain(r[1])) + 1 for r in ROWS)
    assert all(len(r.tokens) == r.length for r in repeated)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pack_block_fills_windows():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 40, 700):
        lengths = [rng.choice([1, 7, 300, 2047, 2048, 2049, 9000]) + rng.randrange(50) for _ in range(n)]
        sequences = packing.pack_block(lengths)
        assert sum(p[2] for s in sequences for p in s) == sum(lengths)
        totals = [sum(p[2] for p in s) for s in sequences]
        assert all(t == 2048 or (t < 2048 and t & (t - 1) == 0) for t in totals)
        assert sum(t < 2048 for t in totals) <= 11


def test_window_count_rises_as_padding_allows():
    rng = random.Random(1)
    lengths = [rng.randrange(20, 600) for _ in range(1500)] + [9000]
    seen = []
    for padding in (0.0, 0.005, 0.02, 1.0):
        sequences = packing.pack_block(lengths, padding=padding)
        assert sum(p[2] for s in sequences for p in s) == sum(lengths)
        totals = [sum(p[2] for p in s) for s in sequences]
        assert max(totals) <= 2048
        lacking = sum(2048 - t for t in totals if t & (t - 1))
        assert lacking <= padding * sum(lengths)
        pieces = sorted(p for s in sequences for p in s)
        assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:]))  # pieces of a document join up
        seen.append(len([p for p in pieces if p[0] != 1500]) - 1500)
    assert seen[0] > seen[1] > seen[2] >= seen[3] == 0  # cuts of documents that a window can hold


def test_difference_is_near_equal():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 2048) for _ in range(900)]
    parts = packing.difference(sizes, 300)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(900))
    assert max(sums) - min(sums) < 0.35 * sum(sizes) / 300


def test_ids_equal_the_library_on_mixed_white_space():
    """10,000 random texts of words, closing punctuation and every mix of up to three white-space characters."""
    import random

    rng = random.Random(6)
    words = ["a", "b", "don't", "Zeit", "été", "x1", "...", "–", "日本", "é", "they'll", "1,000", "(c)", "́", "<|endoftext|>", "ab\x01", "\x01", "ſ", "ǆ", "'s", "o'", "ok!?"]
    closing = ["", "", "", ",", ".", "!?", "'", "'s", "…", ")"]
    white = [" ", " ", " ", " ", "\n", "\t", " ", "\r", " ", "\x1c", "\x0b"]
    encode = bpe.encoder(bpe.default_path())
    texts = []
    for i in range(10_000):
        alphabet = white[:5] if i % 2 else white
        parts = [rng.choice(words) + rng.choice(closing) + "".join(rng.choices(alphabet, k=rng.choice((0, 1, 1, 1, 1, 2, 3) if i % 4 < 2 else (1,)))) for _ in range(rng.randrange(0, 12))]
        texts.append("".join(parts).strip(" ") if i % 3 else "".join(parts))
    for text, own, raw in zip(texts, encode(texts), encode._library(texts)):
        assert own.tobytes() == raw, repr(text)


def test_a_full_memo_is_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    encode = bpe.Encoder(bpe.default_path())
    for k in range(4):
        texts = [f"alpha{k} beta{k}, gamma{k}.", "beta gamma", ""]
        assert [x.tobytes() for x in encode(texts)] == encode._library(texts)
