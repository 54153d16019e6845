import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import phrases, shards

ROOT = Path(__file__).resolve().parents[2]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, most=4, top=2000, percent=80):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,least,shard,most", [(0, 3, 1 << 20, 4), (1, 5, 300, 4), (2, 2, 200, 3), (3, 4, 500, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, least, shard, most):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rng = random.Random(seed)
    words = ["the", "The", "a", "é", "É", "of\xa0x", "\x00", "b\x0b", "x.", "of", "new\tyork", "city", "y,"]
    rows = [(rng.choice(["en", "en", "fr", None, "und", ""]), rng.choice(["", " ", None, *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(9)]])) for _ in range(120)]
    rows += [("en", "new york city is in new york state\n" * 8)] * 4
    assert run(spark, rows, least=least, most=most) == by_hand(rows, least, most)
    assert run(spark, rows, least=least, most=most, top=3) == by_hand(rows, least, most, 3)


def test_overlaps_and_long_runs(spark):
    rows = [("x", "a " * 50), ("x", "a a\na"), ("y", "b c " * 40)]
    found = run(spark, rows, least=5)
    assert found == by_hand(rows, 5)
    assert [r for r in found if r[0] == "x"][0][2:6] == ("a a a a", 47, 53, 48)


def test_empty(spark):
    assert run(spark, [(None, None), ("en", ""), ("en", " .,\n")]) == []
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = (1 << 62) // 3
    found = spark.createDataFrame([("x", "a", 1, big + 5), ("x", "b", 1, big + 1), ("x", "a b", 2, big), ("x", "a b c", 3, big * 4 // 5 + 1), ("x", "b c", 2, big), ("x", "c", 1, big)], "lang string, phrase string, k int, f long")
    rows = {r.phrase: r for r in phrases.scored(found).collect()}
    assert rows["a b"].score == 2_000_000 * big // (2 * big + 6) and rows["a b c"].l == big + 5
    left = {r.phrase for r in phrases.not_covered(phrases.scored(found)).collect()}
    assert left == {"a b c"}


def test_clashing_columns(spark):
    rows = [("en", "p q r s " * 12)] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    odd = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["shard", "names", "keys", "n", "phrase", "k", "a.b", "`q`", "bucket"])])
    assert sorted(map(tuple, phrases.collocations(odd, least=5).collect())) == sorted(map(tuple, phrases.collocations(df, least=5).collect())) != []


def test_levels_do_not_pile_up(spark, monkeypatch):
    """A level is deleted as soon as the next one is there, so at most two are on disk."""
    alive, most = set(), []

    def pruned(*args):
        level = own_pruned(*args)
        alive.add(id(level))
        most.append(len(alive))
        return level

    def dropped(df):
        alive.discard(id(df))
        own_dropped(df)

    own_pruned, own_dropped = phrases.pruned, phrases.dropped
    monkeypatch.setattr(phrases, "pruned", pruned)
    monkeypatch.setattr(phrases, "dropped", dropped)
    rows = [("en", "p q r s t " * 9)] * 4
    assert run(spark, rows, least=5) == by_hand(rows, 5)
    assert max(most) <= 2 and not alive


def worker_peak(code):
    """MB that a Python process has at its peak beyond what it has before ``run()``."""
    import subprocess
    import sys

    run_it = "\nimport resource\npeak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\nbefore = peak()\nrun()\nprint(peak() - before)"
    return float(subprocess.run([sys.executable, "-c", code + run_it], capture_output=True, text=True, check=True, cwd=str(ROOT)).stdout.split()[-1])


BUCKET = """
import numpy as np, pyarrow as pa
from quern.llm import phrases, shards
rng = np.random.default_rng(1)
rows = [shards.sent(s, np.array([0, 12_000]), [np.sort(rng.integers(0, 1 << 60, 12_000).astype(np.uint64)), np.ones(12_000, np.int64)]) for s in range(200)]
group = pa.Table.from_batches(rows)
taken = []
class Rows:
    def groupBy(self, *_): return self
    def applyInArrow(self, run, schema): taken.append(run); return self
    def agg(self, *_): return self
shards.settled, shards.F = (lambda *a: None), type("F", (), {"collect_list": lambda *a: type("C", (), {"alias": lambda *a: 0})(), "struct": lambda *a: 0})
shards.answered(Rows(), ["<u8", "<i8"], phrases.reaches(30), "x")
def run():
    out = taken[0](group)
    assert out.num_rows == 200
"""


def test_a_bucket_is_decided_in_parts():
    """A bucket of 38 MB."""
    assert worker_peak(BUCKET) < 110


def test_states_are_spelled_some_at_a_time(spark, monkeypatch, tmp_path):
    """A level whose states all stay holds places of words and no phrases; spelled rows come in small batches."""
    words = [f"w{i % 997}x{i % 1009}" for i in range(3 * phrases.SPELL_ROWS // 2)]
    level = phrases.first_level({"en": [" ".join(words).encode()]}).next()
    states = len(level.n)
    row = level.only(np.ones(states, bool)).row(3)
    assert states > phrases.SPELL_ROWS and sum(len(row.column(i)[0].as_py()) for i in (5, 6)) < sum(len(w) + 1 for w in set(words)) + 8 * states
    again = phrases.Level.of(row, 0, True)
    assert (again.parts == level.parts).all() and again.words == level.words
    taken = []

    class Rows:
        def select(self, *names):
            self.names = names
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)

    monkeypatch.setattr(shards, "byte_batches", lambda df: df)
    rows = Rows()
    phrases.spelled(rows, 2)
    batches = list(taken[0]([row.select(list(rows.names))]))
    assert max(b.num_rows for b in batches) <= phrases.SPELL_ROWS
    assert sorted(x for b in batches for x in b.column(1).to_pylist()) == sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def test_tables_of_large_rows_have_small_row_groups(spark):
    """80 MB of shards from one task: none is held back until a hundred are there."""
    docs = spark.range(0, 320, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 4096), i -> sha2(cast(id * 4096 + i as string), 256)), '')").alias("text"))
    whole = shards.sharded(docs, "text", "shards", 4 << 20)
    files = [f.removeprefix("file:").replace("///", "/") for f in whole.inputFiles()]
    assert whole.count() > 18 and max(pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).num_row_groups)) <= 10
