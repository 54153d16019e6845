import random
import re
from itertools import combinations

import pytest

from quern.llm import decontaminate as dc
from quern.llm.common import table


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_overlaps(docs, items):
    """Every diagonal of every pair, by the rule alone: no masks."""
    out = {}
    for d, text in docs:
        w = plain_words(text)
        for item, item_text in items:
            b = plain_words(item_text)
            if not b or (len(b) < dc.LEAST_WORDS and w != b):
                continue
            width = min(len(b), dc.WINDOW)
            enough = len(b) if len(b) < dc.WHOLE_BELOW else dc.SHARE * width - 1e-9
            best = None
            for start in range(-len(b) + 1, len(w)):
                eq = [0 <= start + i < len(w) and w[start + i] == b[i] for i in range(len(b))]
                if max(sum(eq[s : s + width]) for s in range(len(b) - width + 1)) >= enough and (best is None or sum(eq) > best[1]):
                    best = (start, sum(eq))
            if best:
                out[d, item] = (*best, len(b))
    return out


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.mark.parametrize("limit", [dc.BROADCAST_SEEDS, 0])
def test_overlaps_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", limit)
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.choice([4, 6, 9, 10, 11, 12, 13, 15, 30, 60])))) for i in range(24)] + [(24, "a b c")]
    docs = []
    for i in range(60):
        own = words(rng, rng.randrange(0, 120))
        if i % 2:
            part = plain_words(rng.choice(items)[1])
            part = part[rng.randrange(0, len(part)) :] if i % 4 == 1 else part
            part = [w if rng.random() > (i % 5) * 0.06 else "other" for w in part]
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = part
        docs.append((i, ", ".join(own).upper()))
    docs += [(60, "A, b; c"), (61, "a b c d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.equal_words, r.item_words) for r in dc.overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_overlaps(docs, items)
    assert got == want and len(want) > 10


def test_op7_finds_planted_items(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: " ".join(plain_words(r.text)) for r in table(spark, sf, "benchmark").collect()}
    want = {(r.doc_id, i) for r in table(spark, sf, "documents").collect() for i, b in items.items() if f" {b} " in f" {' '.join(plain_words(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in dc.op7_decontaminate(spark, sf).collect()}
    assert want and got == want


def test_edge_cases(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [
        (1, None, "a", None), (2, "", "a", None), (None, item, "a", 1), (3, item, "a", 2), (3, item, "a", 2),
        (4, "clean text of some length that has nothing to do with any item at all", None, None),
        (5, "filler " * 60_000 + item, None, None), (3, "another text under the same id", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, h long")
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, None), (3, "too short", None), (None, item, None)], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.start) for r in dc.overlaps(docs, items).collect()))
    assert got == [(0, 0, 0), (0, 1, 0), (3, 0, 0), (3, 1, 0), (5, 0, 60_000), (5, 1, 60_000)]
    kept = dc.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in kept.collect()) == [(1, ""), (2, ""), (3, "another"), (4, "clean t")]
    assert dc.overlaps(docs.limit(0), items).count() == 0 and dc.overlaps(docs, items.limit(0)).count() == 0
    assert dc.decontaminated(docs, items.limit(0)).count() == len(rows)


def met(n, gone, masks):
    return any(all(j + c not in gone for c, x in enumerate(m) if x == "1") for m in masks for j in range(n - len(m) + 1))


@pytest.mark.parametrize("n", [10, 11, 12, 13, 14, 20, 30])
def test_masks_meet_every_accepted_pattern(n):
    wrong = n - dc.least_equal(n, dc.SHARE)
    masks = dc.masks_for(n, wrong)
    assert all(m.count("1") == dc.WEIGHT and m[0] == m[-1] == "1" for m in masks)
    some = list(combinations(range(n), wrong)) if n < 20 else [random.Random(i).sample(range(n), wrong) for i in range(3000)]
    assert all(met(n, set(gone), masks) for gone in some)


def test_every_pattern_of_two_words_is_found(spark):
    """Items of 10 to 13 words alone in a document, with each pair of their words replaced."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (10, 11, 12, 13)]
    docs = []
    for n, text in items:
        for gone in combinations(range(n), 2):
            docs.append((len(docs), " ".join("x" if k in gone else w for k, w in enumerate(text.split()))))
    got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [d for d, _ in docs]


def test_other_windows_and_shares(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(i, " ".join("x" if k in random.Random(i).sample(range(20), i % 6) else f"w{k}" for k in range(20))) for i in range(60)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    for window, least in ((20, 16), (8, 7)):
        equal = {d: [a == b for a, b in zip(t.split(), item.split())] for d, t in docs}
        want = [d for d, e in equal.items() if max(sum(e[s : s + window]) for s in range(21 - window)) >= least]
        assert sorted(r.doc_id for r in dc.overlaps(*frames, window=window).collect()) == want


def test_sql_on_short_items(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((3, 4, 5, 9, 10, 11, 12, 20))]
    rows = [(i, " ".join([*words(rng, 20), *plain_words(items[i % 8][1])[: rng.choice((3, 20))], *words(rng, 9)])) for i in range(40)] + [(40, None), (41, items[0][1])]
    documents, benchmark = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    got = dc.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(tuple, got.select("doc_id", "item_id", "start", "equal_words", "item_words").collect()))
    assert got == sorted(duckdb.sql(dc.oracle()).fetchall()) and {r[1] for r in got} == set(range(8))
