import sys

import pytest

import __spark_entry__ as entry
from quern import evaluation_queries as engine


@pytest.mark.parametrize("blocked", ["quern.llm", "quern.llm.queries", "quern.llm.html"])
def test_text_operators_are_optional(monkeypatch, blocked):
    for name in [n for n in sys.modules if n == "quern.llm" or n.startswith("quern.llm.") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, blocked, None)  # its import fails
    assert set(entry.queries()) == set(engine.QUERIES)
    assert set(entry.oracle_sql()) == set(engine.ORACLES)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == engine.QUERIES["cumulative_gain"](spark, "/root/testdata/sf0.001").columns
