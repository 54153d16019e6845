"""Further columns with odd and clashing names: no operator or stage fails on them or gives other results."""

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, fingerprints, html, language, licenses, packing, quality, simhash, token_files, warc
from quern.llm.common import scratch_path, table

ODD = ["my col", "n-chars", "a.b", "`q`", "d", "kept", "key", "keys", "node", "root", "turn", "hot_key", "s_chars", "s_words", "score", "label", "fp", "fp1", "row", "bucket", "place", "order", "text_hash", "own_id", "own_hash", "leak_id", "kept_id", "deal", "lo", "hi", "side", "n", "word", "words", "w", "h", "at", "seed", "start", "item_id", "form", "digest", "name", "host", "run", "runs", "pages", "text_for_python", "lang_pred", "component_id", "least", "blocks", "own", "other", "starts", "named"]


def with_odd(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD)])


def tokens(docs):
    path = scratch_path(docs.sparkSession, "names")
    token_files.write_token_files(docs, path)
    return token_files.token_file_digests(docs.sparkSession, path)


def archive(pages):
    path = scratch_path(pages.sparkSession, "names")
    warc.write_warc(pages, path)
    return warc.resolve(warc.read_warc(pages.sparkSession, path))


def learned(docs):
    return language.identify(docs, language.fit_languages(docs), ["doc_id"])


def scored(docs):
    labels = with_odd(table(docs.sparkSession, "/root/testdata/sf0.001", "labels"))
    return quality.score_quality(docs, quality.fit_quality(docs, labels), ["doc_id"])


OPERATORS = {
    "licenses": licenses.scan_licenses,
    "language": learned,
    "simhash": simhash.near_duplicates,
    "similar": simhash.similar_documents,
    "fingerprints": fingerprints.edited_fingerprints,
    "tokens": tokens,
    "decontaminate": lambda docs: decontaminate.overlaps(docs, with_odd(table(docs.sparkSession, "/root/testdata/sf0.001", "benchmark").withColumnRenamed("item_id", "i")).withColumnRenamed("item_id", "other_item").withColumnRenamed("i", "item_id")),
    "quality": scored,
    "packing": packing.pack,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_documents(spark, sf_dir, name):
    docs = table(spark, sf_dir, "documents").limit(60).repartition(1)
    docs = spark.createDataFrame(sorted(docs.collect()), docs.schema).coalesce(1)
    plain = sorted(map(str, OPERATORS[name](docs).collect()))
    assert plain == sorted(map(str, OPERATORS[name](with_odd(docs)).collect()))


@pytest.mark.parametrize("run", [html.extract_main_text, archive])
def test_operators_on_pages(spark, sf_dir, run):
    pages = table(spark, sf_dir, "pages")
    assert sorted(map(str, run(pages).collect())) == sorted(map(str, run(with_odd(pages)).collect()))


def test_kept_columns_of_any_name(spark, sf_dir):
    docs = with_odd(table(spark, sf_dir, "documents").limit(20))
    keep = [c for c in docs.columns if c not in ("score", "lang_pred", "a.b", "`q`")]
    assert quality.score_quality(docs, quality.RuleEnsemble(0.5), [f"`{c}`" for c in keep]).columns == [*keep, "score"]


def test_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = table(spark, sf_dir, "documents")
    odd = with_odd(docs)
    for name, stage in cp.STAGES:
        out, want = stage(spark, odd, sf_dir), stage(spark, docs, sf_dir)
        if name == "packing":
            assert out.count() == want.count()
        else:
            assert out.columns == odd.columns
            assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in want.collect())
            assert out.select(*[f"`{c}`" for c in ODD if c != "`q`"]).distinct().count() <= 1
