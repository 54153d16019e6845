import hashlib
import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import repeats
from quern.llm.common import table


def by_hand(rows, least):
    """{place: (n_bytes, spans, kept)} of (id, text) rows; a null id is the smallest."""
    data = [((-1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        spans = [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2])]
        out.append((len(b), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, doc_id long, text string").repartition(5)
    found = sorted(repeats.repeated_spans(df, **how).collect(), key=lambda r: r.d.k)
    assert [(r.d.doc_id, r.d.text) for r in found] == rows
    return [(len((r.d.text or "").encode()), [tuple(s) for s in r.spans], bytes(r.kept)) for r in found]


@pytest.mark.parametrize("seed,least,shard", [(0, 50, 1 << 20), (1, 50, 700), (2, 12, 400), (3, 5, 300), (4, 3, 200), (5, 90, 2000)])
def test_equals_brute_force(spark, seed, least, shard):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abécd ") for _ in range(rng.randrange(1, 8)))
    passages = ["".join(word() for _ in range(rng.randrange(2, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([rng.choice(passages), word(), word()]) for _ in range(rng.randrange(0, 12)))
        rows.append((rng.choice([i, i, 7, None]), rng.choice([text, text, text, None, ""])))
    rows += [rows[3], rows[10], (-5, rows[20][1]), (1 << 62, rows[20][1])]
    assert run(spark, rows, least=least, shard_bytes=shard) == by_hand(rows, least)


def test_cases(spark):
    line = "".join(chr(97 + i * 7 % 26) for i in range(60))
    rows = [(5, line[:49]), (6, line[:49]), (1, line), (2, "x" + line[:50] + "y" + line[10:]), (3, "é" * 40), (4, "é" * 40 + "z"), (9, "ab" * 200), (10, "ab" * 30), (10, "ab" * 30), (None, None)]
    found = run(spark, rows)
    assert found == by_hand(rows, 50)
    assert found[0][1] == found[1][1] == found[2][1] == [] and found[3] == (102, [(1, 51), (52, 102)], b"xy")
    assert found[6][1] == [] and found[7][1] == found[8][1] == [(0, 60)]  # equal ids don't remove from each other, nor does a text from itself
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated_spans(empty).collect() == []
    assert run(spark, [(1, None), (2, "")]) == [(0, [], b"")] * 2


def test_a_third_of_all_rows_equal_and_a_long_text(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, long = some(300), some(60_000)
    rows = [(i, hot if i % 3 == 0 else some(200)) for i in range(300)] + [(1000, long), (1001, some(100) + long[20_000:30_000])]
    found = run(spark, rows, shard_bytes=4000)
    assert found == by_hand(rows, 50)
    assert sum(f[1] == [(0, 300)] for f in found) == 99 and found[-1][1][0][0] in range(95, 101) and found[-1][1][0][1] == 10_100


def test_covers():
    for period, cover in repeats.COVERS.items():
        assert {(a - b) % period for a, b in itertools.product(cover, repeat=2)} == set(range(period))
    assert repeats.cover_of(50)[0] == 31 and all(repeats.cover_of(n)[0] <= n for n in range(1, 200))


def test_hashes_agree():
    data = np.frombuffer(bytes(random.Random(1).randbytes(5000)) + bytes(8), np.uint8)
    for length in (1, 7, 8, 9, 50):
        keys, checks = repeats.string_hashes(data, length, step=700)
        assert len(keys) == len(checks) == 5000 - length + 1
        assert (keys == repeats.string_hash(data, np.arange(len(keys)), length)).all()
        strings = {bytes(data[i : i + length]) for i in range(len(keys))}
        assert len(set(keys.tolist())) == len(strings) and (length < 8 or len(set(checks.tolist())) > 0.99 * len(strings))


def test_keys_of_equal_hashes_and_other_checks():
    """Equal 64-bit keys with different checks stay apart."""
    key, check, ids = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32), np.array([4, 1, 3, 2], np.int64)
    assert repeats.has_smaller([key, check, ids], np.arange(4)).tolist() == [True, False, False, False]


def test_clashing_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plain = {r.d.doc_id: (r.spans, r.kept) for r in repeats.repeated_spans(docs).collect()}
    names = ["shard", "docs", "d", "n", "bits", "data", "spans", "kept", "bucket", "a.b", "`q`", "text_for_python"]
    odd = repeats.repeated_spans(docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]))
    rows = odd.collect()
    assert {r.d.doc_id: (r.spans, r.kept) for r in rows} == plain
    assert all(tuple(r.d)[-len(names) :] == tuple(range(len(names))) for r in rows)


def test_op12_equals_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    want = [(i, n, sum(z - a for a, z in s), len(s), hashlib.sha256(k).hexdigest()) for (i, _), (n, s, k) in zip(docs, by_hand(docs, 50))]
    assert sorted(tuple(r) for r in repeats.op12_repeats(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want


SHARD = """
import resource
import numpy as np
from quern.llm import repeats
n = 8 << 20
data = np.concatenate((np.random.default_rng(0).integers(97, 123, n).astype(np.uint8), np.zeros(8, np.uint8)))
first = np.arange(0, n, 2000)
last = np.minimum(first + 2000, n) - 50
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
found = repeats.open_hashes(data, first, last, 50, (0, 512, 512))
places = 0
for span in ((0, 170, 512), (170, 341, 512), (341, 512, 512)):
    own = repeats.Suffixes(found, first, np.arange(len(first)), span)
    assert len(own.edges) == span[1] - span[0] + 1 and own.edges[0] == 0 and own.edges[-1] == len(own.key)
    places += len(own.at)
    del own
assert places == (last - first + 1).sum()
print(peak() - before)
"""


def test_a_shard_with_all_places_open_takes_bounded_memory():
    """8 MB whose strings all go on: a block's suffixes are in memory, not all of them."""
    root = str(Path(repeats.__file__).resolve().parents[2])
    assert float(subprocess.run([sys.executable, "-c", SHARD], capture_output=True, text=True, check=True, cwd=root).stdout) < 380


WHOLE_SHARD = """
import resource
import numpy as np
from quern.llm import repeats
n = repeats.SHARD_BYTES
data = np.concatenate((np.random.default_rng(0).integers(97, 123, n).astype(np.uint8), np.zeros(8, np.uint8)))
first, last = np.array([0]), np.array([n - 50])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
before = peak()
at, keys, checks = repeats.open_hashes(data, first, last, 50, (0, 512, 512))
print(peak() - before)
assert len(at) == len(keys) == len(checks) == n - 49
"""


def test_hashes_of_a_whole_shard_are_held_once():
    """16 bytes a place, a mark for each, and no second copy."""
    root = str(Path(repeats.__file__).resolve().parents[2])
    assert float(subprocess.run([sys.executable, "-c", WHOLE_SHARD], capture_output=True, text=True, check=True, cwd=root).stdout) < 100


def test_spans_with_more_than_their_share():
    """Equal strings everywhere: one span has all places, the others have none."""
    data = np.frombuffer(b"a" * 100_000 + bytes(8), np.uint8)
    found = [repeats.open_hashes(data, np.array([0]), np.array([100_000 - 50]), 50, (i, i + 1, 4), step=512)[0] for i in range(4)]
    assert sorted(map(len, found)) == [0, 0, 0, 100_000 - 49]
