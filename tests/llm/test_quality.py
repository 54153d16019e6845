import math
import zlib

import numpy as np

from quern.llm import quality
from quern.llm.common import table


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    docs = table(spark, sf, "documents")
    rows = quality.op8_quality(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97


def test_compiled_column_equals_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    assert model.rules
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score_quality(docs, model, ["doc_id"]).collect():
        x = {n: np.array([v]) for n, v in zip(quality.STATISTICS, quality.statistics(texts[r.doc_id]))}
        margin = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if rule.holds(x)[0])
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-12


def test_lasso_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = (rng.random((500, 6)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1])))).astype(float)
    b, w = quality.lasso_logistic(x, y, 0.01, steps=3000)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert np.all(np.abs(gradient[w == 0]) <= 0.01 + 1e-4)
    assert np.allclose(gradient[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4)
    big = quality.lasso_logistic(x, y, 10.0)[1]
    assert not big.any()


def test_quality_edge_cases(spark):
    good = "This is a calm sentence about the river, and it goes on for a while."
    rows = [(i, good + f" Number {i}.", "x", "y") for i in range(20)] + [(i, "BUY NOW!! $$$ | ### " * 8 + str(i), "x", None) for i in range(20, 40)]
    rows += [(40, None, None, None), (41, "", None, None), (None, good, None, None), (1, rows[1][1], None, None), (42, "word " * 60_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label string")
    labels = spark.createDataFrame(
        [(i, int(i < 20), 0) for i in range(40)] + [(41, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int"
    )
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert min(scores[i] for i in range(20)) > max(scores[i] for i in range(20, 40))
    assert scores[40] == scores[41]
    assert quality.score_quality(docs.limit(0), model, ["doc_id"]).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0)]):
        model = quality.fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert not model.rules
        assert len({r.score for r in quality.score_quality(docs, model, ["doc_id"]).collect()}) == 1


def plain_statistics(text):
    """The statistics from their definitions, one character, word and line at a time."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    words, lines, n = raw.split(), [x for x in raw.split(b"\n") if x], len(raw)
    lengths = [len(w) for w in words] or [0]
    k, mean = max(1, len(words)), sum(lengths) / len(lengths)
    share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / n
    marks = b".,;:!?|"
    return {
        "chars": math.log(1 + len(text)), "words": math.log(1 + len(words)), "word_length": mean,
        "word_length_deviation": math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)),
        "short_words": sum(x <= 3 for x in lengths) / len(lengths), "long_words": sum(x >= 12 for x in lengths) / len(lengths),
        "distinct_words": len(set(words)) / k, "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:])) / k,
        "top_byte": max(raw.count(bytes([c])) for c in range(256) if c != 32) / n, "lines": math.log(1 + len(lines)), "line_words": k / max(1, len(lines)),
        "distinct_lines": len(set(lines)) / max(1, len(lines)), "upper": share(range(65, 91)), "lower": share(range(97, 123)), "digits": share(range(48, 58)),
        "blanks": share(b" \t\n\r\x0b\x0c"), "stops": share(b"."), "commas": share(b",;:"), "shouts": share(b"!?"), "bars": share(b"|"),
        "symbols": share(b"#$%&*+<=>@\\^_`~{}[]/"), "other_bytes": share(range(128, 256)),
        "capitalised": sum(65 <= w[0] <= 90 for w in words) / k if words else 0.0, "closing_punctuation": sum(w[-1] in marks for w in words) / k if words else 0.0,
    }


def test_op8_equals_brute_force(spark, sf_dir):
    """The whole query: statistics from their definitions, rules one at a time, for every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, usable=quality.fold(5) != 0)
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and model.rules
    for r in rows:
        x, margin = plain_statistics(r.text), model.intercept
        for rule, weight in zip(model.rules, model.weights):
            if all((x[name] > t) if above else (x[name] <= t) for name, above, t in rule.terms):
                margin += weight
        score = 1 / (1 + math.exp(-margin))
        own = got[r.doc_id]
        near = min(abs(x[name] - t) for rule in model.rules for name, _, t in rule.terms)  # at a threshold the last bit decides
        assert near < 1e-9 or abs(own.score - score) < 1e-9 and own.predicted == int(score >= 0.3)
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_weights_in_use_are_optimal(spark):
    """The fit of the query stops where the lasso's conditions hold."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.standard_normal(3000) > 0).astype(float)
    rules = quality.tree_rules(x, y, trees=24, depth=3, least=20, seed=8)
    columns = {n: x[:, j] for j, n in enumerate(quality.STATISTICS)}
    held = np.stack([r.holds(columns) for r in rules], axis=1).astype(float)
    b, w = quality.lasso_logistic(held, y, 1e-3)
    gradient = held.T @ (1 / (1 + np.exp(-(held @ w + b))) - y) / len(y)
    assert np.all(np.abs(gradient[w == 0]) <= 1e-3 + 2e-4) and np.allclose(gradient[w != 0], -1e-3 * np.sign(w[w != 0]), atol=2e-4)
