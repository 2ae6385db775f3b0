"""Every registered query runs end to end on the smallest tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = sorted(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "rank", "doc_id", "dist"]
    assert df.count() > 0


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_the_library_registers_without_the_corpus_operators(monkeypatch):
    found = E.find_spec
    for gone in ("tallyframe.llm", "corpus_pipeline"):
        monkeypatch.setattr(E, "find_spec", lambda name, gone=gone: None if name == gone else found(name))
        names = set(E.queries())
        assert names and not any(n == "pipeline" or n.startswith("op") for n in names) and set(E.oracle_sql()) <= names


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert len(df.columns) == len(set(df.columns))
    df.limit(5).collect()
