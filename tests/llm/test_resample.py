import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def by_hand(docs, target, most=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n, own = features(text, most)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[2]))[: sum(r[4] for r in rows) * percent // 100]
    place, drawn = {}, Counter()
    for k, r in enumerate(fit, 1):
        place.setdefault(r, []).append(k)
    out = []
    for r in rows:
        drawn[r] += 1
        ranks = place.get(r, [])
        out.append((*r[:4], ranks[drawn[r] - 1] if drawn[r] <= len(ranks) else None))
    return sorted(out, key=str)


def run(spark, docs, target, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in resample.resample(d, t, **how).collect()), key=str)


def some(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "B", "é", "É", "x1", "don't", "-", "\n", "naïve", "0", "[]", "日本"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "", "_"]) for _ in range(k))
    docs = [(i, rng.choice([None, "", text(5), text(60), text(100)])) for i in range(n)]
    return docs + [(3, docs[5][1]), docs[7], docs[7], (None, text(50))], [text(30) for _ in range(6)] + [None, ""]


@pytest.mark.parametrize("seed,most,percent", [(0, 1, 10), (1, 3, 50), (2, 2, 100), (3, 1, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, most, percent):
    monkeypatch.setattr(resample, "BLOCK_BYTES", 500)
    docs, target = some(seed)
    got = run(spark, docs, target, most=most, percent=percent, buckets=50)
    assert [r[:4] for r in got] == [r[:4] for r in by_hand(docs, target, most, 50, percent=percent)]
    assert [r for r in got if r[4]] == [r for r in by_hand(docs, target, most, 50, percent=percent) if r[4]]


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    docs, _ = some(4, 20)
    assert run(spark, docs, []) == by_hand(docs, [])


def test_long_text(spark):
    docs = [(1, "w v u " * 120_000), (2, "w " * 30), (3, "v " * 19)]
    assert run(spark, docs, ["w"], percent=100) == by_hand(docs, ["w"], percent=100)


def test_runs_of_a_suffix_array():
    rng = np.random.default_rng(0)
    words, sizes = rng.integers(0, 4, 60), [0, 25, 1, 34]
    left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
    for k, suffixes, starts in resample.suffix_runs(words, left, 3):
        grams = [tuple(words[i : i + k]) for i in suffixes]
        assert sorted(suffixes) == [i for i in range(60) if left[i] >= k] and grams == sorted(grams)
        assert [i for i in range(len(grams)) if i == 0 or grams[i] != grams[i - 1]] == starts.tolist()


def test_clashing_columns(spark):
    docs, target = some(5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    odd = d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["bucket", "n", "weight", "score", "rank", "fit", "at", "part", "a.b", "`q`"])])
    assert sorted(map(str, resample.resample(odd, t).collect())) == sorted(map(str, resample.resample(d, t).collect()))
