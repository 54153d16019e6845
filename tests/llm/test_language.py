import zlib

import numpy as np
import pytest

from quern.llm import language
from quern.llm.common import table


def plain_bundle(text, dimension):
    """The definition, one trigram at a time."""
    own = language.Space(dimension)
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = np.zeros(dimension)
    if words:
        padded = [0] + [ord(c) for c in " ".join(words)] + [0]
        padded = [0 if c == 32 else c for c in padded]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            out += np.roll(own.letter(a), 2) * np.roll(own.letter(b), 1) * own.letter(c)
    return out


def test_bundles_equal_definition():
    texts = ["The cat sat.", "", None, "…!", "àÉ 漢字 the", "aaa  aaa\naaa", "ǅ İstanbul"]
    got = language.Space(256).bundles(texts)
    for t, v in zip(texts, got):
        if t != "ǅ İstanbul":
            np.testing.assert_allclose(v, plain_bundle(t, 256), atol=1e-3)


def test_cache_overflow_changes_nothing(monkeypatch):
    texts = ["".join(chr(97 + (i * j) % 26) for j in range(400)) for i in range(1, 20)]
    want = language.Space(64).bundles(texts)
    monkeypatch.setattr(language, "CACHE_ROWS", 50)
    small = language.Space(64)
    got = np.concatenate([small.bundles(texts[:10]), small.bundles(texts[10:])])
    np.testing.assert_allclose(got, want, atol=1e-3)


def test_op2_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = language.op2_language(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string, v string"


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog and the bird", "en", "a", "b", "c") for i in range(3)]
    rows += [(i, "le chat et le chien avec les oiseaux", "fr", "a", None, None) for i in range(3, 6)]
    rows += [(6, None, "en", None, None, None), (7, "", "fr", None, None, None), (8, "12 --", None, None, None, None)]
    rows += [(None, "the bird and the cat", None, None, None, None), (9, "les oiseaux " * 20_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit_languages(docs)
    assert list(model) == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        0: "en", 1: "en", 2: "en", 3: "fr", 4: "fr", 5: "fr", 6: "und", 7: "und", 8: "und", None: "en", 9: "fr",
    }
    assert got[6][1] == got[8][1] == 0.0 and got[0] == got[1]


@pytest.mark.parametrize("rows", [[], [(1, "the cat", None, None, None, None)]])
def test_nothing_learned(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit_languages(docs)
    assert model == {}
    assert [r.lang_pred for r in language.identify(docs, model, ["doc_id"]).collect()] == ["und"] * len(rows)


def test_op2_equals_brute_force(spark, sf_dir):
    """The whole query, one text and one trigram at a time: prototypes, cosines and predictions."""
    docs = table(spark, sf_dir, "documents").collect()
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    vectors = {r.doc_id: unit(plain_bundle(r.text, language.DIMENSION)) for r in docs}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    names = sorted({r.lang for r in docs if r.lang and not held[r.doc_id]})
    prototypes = np.stack([unit(sum(vectors[r.doc_id] for r in docs if r.lang == n and not held[r.doc_id])) for n in names])
    got = {r.doc_id: r for r in language.op2_language(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        cosines = prototypes @ vectors[r.doc_id]
        letters = any(c.isalpha() for c in r.text or "")
        assert got[r.doc_id].lang_pred == (names[int(cosines.argmax())] if letters else "und") and got[r.doc_id].held_out == held[r.doc_id]
        assert abs(got[r.doc_id].score - (min(1, max(0, cosines.max())) if letters else 0)) < 1e-4


def test_repeated_and_null_ids_teach(spark):
    """A language whose rows all share an id, have none, or are all equal is learned like any other."""
    texts = {"en": "the words of this text are the ones of that house ", "fr": "les mots de ce texte sont ceux de cette maison ", "de": "die wörter dieses textes sind die von jenem haus "}
    rows = [(7, texts["en"] + str(i), "en") for i in range(300)] + [(None, texts["fr"] + str(i), "fr") for i in range(300)] + [(9, texts["de"], "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    learned = language.fit_languages(docs, texts_per_language=40)
    assert sorted(learned) == ["de", "en", "fr"]
    found = language.identify(docs, learned, ["lang"]).where("lang <> lang_pred")
    assert found.isEmpty()
