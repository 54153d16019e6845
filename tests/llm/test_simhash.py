import random

import numpy as np
import pytest
import xxhash

from quern.llm import components as cc
from quern.llm import simhash
from quern.llm.common import table


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_op3_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, plain_components([d for d, _ in docs], fps, 4))}
    assert set(map(tuple, simhash.op3_simhash(spark, sf_dir).collect())) == want


@pytest.mark.parametrize("radius,count", [(4, 3), (3, 2), (2, 4), (0, 1), (7, 4)])
def test_links_equal_brute_force(spark, radius, count):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in list(fps):
        for _ in range(4):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, radius + 3)):
                x ^= 1 << b
            fps.append(x)
    dense = rng.getrandbits(64)
    for _ in range(300):  # a bucket far above SMALL
        fps.append(dense ^ sum(1 << b for b in rng.sample(range(64), 5)))
    rows = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(rows, radius=radius, count=count).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(list(range(len(fps))), fps, radius)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    test_links_equal_brute_force(spark, 4, 3)


def test_near_duplicates_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (3, None, "a", 1),
        (1, "", "a", 1),
        (None, "one two three four five", "a", 1),
        (7, "One  two\tthree FOUR five", None, None),
        (7, "One  two\tthree FOUR five", None, None),
        (None, "something wholly different from the rest of them", "a", 1),
        (4, "ÀB short", "a", 1),
        (9, long, "a", 1),
        (8, long + " x", "a", 1),
    ]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components([r[0] for r in rows], fps, 4)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], signed(f), c) for r, f, c in zip(rows, fps, want)), key=key)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_similar(texts, k=5, least=0.8):
    """For each text the least place of those that a Jaccard similarity of ``least`` connects it with."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root, owners = list(range(len(texts))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        near = {i2 for x in s for i2 in owners.get(x, ())} if s else {j for j in range(i) if not sets[j]}
        for j in near:
            if not s or len(s & sets[j]) >= least * len(s | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            owners.setdefault(x, []).append(i)
    return [find(i) for i in range(len(texts))]


def near_copies(rng, bases=40, copies=6, words=120):
    """Texts and copies of them with some words replaced, up to about a Jaccard similarity of 0.8."""
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    texts = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=words)
        texts.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for at in rng.sample(range(words), rng.randrange(0, 5)):
                other[at] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    return texts


def test_similar_documents_find_near_copies(spark, monkeypatch):
    texts = near_copies(random.Random(3)) + [None, "", " \n", "one two", "One two", "one three"]
    texts += [t for t in near_copies(random.Random(4), bases=1, copies=60)]
    want = plain_similar(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (simhash.TEXTS, 16):  # a component of many blocks has the same links
        monkeypatch.setattr(simhash, "TEXTS", size)
        got = dict(map(tuple, simhash.similar_documents(rows).collect()))
        assert len(got) == len(texts)
        linked = [i for i, r in enumerate(want) if r != i]
        assert all(want[got[i]] == want[i] for i in got)  # nothing else is linked
        assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
        assert [got[i] == want[i] for i in linked if plain_similar([texts[i], texts[want[i]]], least=1.0)[1] == 0].count(False) == 0


def test_similar_documents_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    want = plain_similar([t for _, t in docs])
    got = dict(map(tuple, simhash.similar_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect()))
    linked = [i for i, r in enumerate(want) if r != i]
    assert all(docs[want[i]][0] <= got[d] for i, (d, _) in enumerate(docs))
    assert sum(got[docs[i][0]] == docs[want[i]][0] for i in linked) >= 0.9 * len(linked) > 0
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_pairs_equal_brute_force():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in (0, 0, 1, 5, 30, 30, 38, 39, 40, 200, 200)]
    got = simhash.similar_pairs(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (len(x & y) >= 0.8 * len(x | y) if x and y else not x and not y)


def test_components_split_large_stars(spark):
    edges = [(3, 10_000 + i) for i in range(1500)] + [(20_000 + i, 9_999_999) for i in range(1500)] + [(10_001, 20_001)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert set(got.values()) == {3} and len(got) == 3002


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5), (2000, 1999)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1051), 1000), 1999: 1999, 2000: 1999}


def test_stars_span():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    a, b = simhash.stars(u, v)
    roots = dict(zip(a, b))
    for x, y in zip(u, v):
        assert roots.get(x, x) == roots.get(y, y)
