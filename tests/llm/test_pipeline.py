import random
import re

import corpus_pipeline as cp
from quern.llm.common import table, written
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_simhash import plain_similar
from tests.llm.test_tokens import check_pieces


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    from quern.llm import bpe

    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "language", "near_dedup", "decontaminate", "packing"]
    seen = [docs]
    for name, stage in cp.STAGES:
        out = written(stage(spark, seen[-1], sf_dir), "test")
        if name != "packing":
            assert out.columns == docs.columns
        seen.append(out)
    before = [rows_of(x) for x in seen[:5]]
    good = [d for d, q in labels.items() if q == 1]
    kept = {d for d, _ in before[1]}
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * max(1, len(labels) - len(good))
    assert before[2] == [r for r in before[1] if re.search(r"[^\W\d_]", r[1] or "")]
    before[2].sort(key=lambda r: r[0])
    classes = plain_similar([t for _, t in before[2]])
    want = {before[2][i][0] for i, c in enumerate(classes) if c == i}
    found = {d for d, _ in before[3]}
    assert want <= found and len(found - want) <= 0.1 * (len(before[2]) - len(want))
    items = [f" {' '.join(plain_words(r.text))} " for r in table(spark, sf_dir, "benchmark").collect()]
    leaks = {d for d, t in before[3] if any(i in f" {' '.join(plain_words(t))} " for i in items)}
    assert leaks and before[4] == [r for r in before[3] if r[0] not in leaks]
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    assert check_pieces(seen[5].collect(), before[4], lambda x: t.encode(x or "", add_special_tokens=False).ids) == 0


def test_odd_rows(spark, sf_dir):
    text = "The river is calm today, and the people walk along it to the old bridge by the mill with their dogs."
    other = "A quite different story is told here about the mountains, the snow and the long way up to the hut."
    third = "In the town there was a market every week, where the farmers sold what they had grown in the fields."
    rows = [(5, text, "en", "a", 1, "x"), (5, text, "en", "a", 1, "x"), (3, text, None, None, None, None), (None, text, None, None, None, None)]
    rows += [(None, other, "en", None, 2, "y"), (None, other, "en", None, 2, "y"), (7, third, None, None, 3, None), (8, None, "en", "a", 0, "z"), (9, "", "en", "a", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = written(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert rows_of(out) == sorted([(3, text), (None, other), (7, third), (8, None)], key=str)
        if name == "language":
            assert rows_of(out) == sorted([(r[0], r[1]) for r in rows if r[1]], key=str)


def test_language_rejects_what_it_never_learned(spark):
    sf, rng = "/root/testdata/sf0.01", random.Random(4)
    docs = table(spark, sf, "documents")
    alphabets = ["bcdfghjklmnpqrstvwxz"] + ["".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5200), (0x627, 0x64A))]
    noise = [" ".join("".join(rng.choices(a, k=rng.randrange(3, 9))) for _ in range(n)) for a in alphabets for n in (12, 40, 200) for _ in range(20)]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    kept = {r.doc_id for r in cp.language(spark, docs.unionByName(rows, allowMissingColumns=True), sf).select("doc_id").collect()}
    assert not [noise[-1 - d] for d in kept if d < 0]
    clean = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    assert len(clean) > 100 and clean <= kept


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
