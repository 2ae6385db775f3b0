"""Queries with a DuckDB statement: equal rows on the small tables and on
tables of awkward rows."""

import random

import duckdb
import pyarrow.parquet as pq
import pytest
from brute import DOC_SCHEMA, awkward_documents, empty_like

from tallyframe.llm.queries import QUERIES

WITH_SQL = [n for n, (_, sql) in QUERIES.items() if sql]
SF = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    fn, sql = QUERIES[name]
    got = fn(spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)

    def norm(r):
        return tuple(round(v, 6) if isinstance(v, float) else v for v in r)

    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((norm(r) for r in got.select(*cols).collect()), key=key) == sorted(map(norm, cur.fetchall()), key=key)


@pytest.mark.parametrize("name", WITH_SQL)
def test_small_tables(spark, name):
    compare(spark, name, SF)


def pages(spark):
    big = "<p>" + "copy " * 400 + "</p>"
    rng = random.Random(3)
    hosts = [f"h{i}.com" for i in range(8)] + ["t.example.net", "bad.net", "f.org"]
    rows = [(1, "http://A.B/x?y", big, 1), (1, "http://A.B/x?y", big, 1), (2, None, big, 1), (None, "no scheme", big, 1), (3, "", "<p>s</p>", 1),
            (4, "https://x.example.net", "<p>s</p>", 2), (5, "https://x.example.net/en/", None, 2), (6, "s://EXAMPLE.com/de/q#f", "", None),
            (None, None, None, None), (7, "http://a\nb.net/x", "é" * 600, 1), (8, "http://u.org/fr", "é" * 600, 1)]
    for i in range(60):
        links = "".join(f'<a href="{rng.choice(["http:", "HTTPS:", ""])}//{rng.choice(hosts)}/q">l</a>' for _ in range(rng.randint(0, 4)))
        rows.append((100 + i, f"http://{rng.choice(hosts)}{rng.choice(['/en/x', '/fr/y', '/de/', '', '/z'])}", f"<html>{links}</html>", 0))
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, digest int, host string")


def benchmark(spark):
    base = " ".join(f"word{i % 97} and{i % 13}" for i in range(40))
    rows = [(1, base), (2, base[40:]), (10, "other TEXT"), (11, ""), (None, "word1 and1"), (12, None), (13, "été")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, k string")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("awkward"))
    awkward_documents(spark, [(20 + i, f"Été other text {i}", "fr", f"s{i}") for i in range(9)]).write.parquet(f"{d}/documents.parquet")
    pages(spark).write.parquet(f"{d}/pages.parquet")
    benchmark(spark).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    for name, df in (("documents", spark.createDataFrame([], DOC_SCHEMA)), ("pages", pages(spark)), ("benchmark", benchmark(spark))):
        empty_like(df).write.parquet(f"{d}/{name}.parquet")
        assert pq.read_table(f"{d}/{name}.parquet").num_rows == 0
    return d


@pytest.mark.parametrize("name", WITH_SQL)
def test_awkward_rows(spark, awkward, name):
    compare(spark, name, awkward)


@pytest.mark.parametrize("name", WITH_SQL)
def test_empty_tables(spark, nothing, name):
    fn, _ = QUERIES[name]
    assert fn(spark, nothing).count() == 0


def test_empty_benchmark_hits_nothing(spark, awkward):
    from tallyframe.llm.decontaminate import contamination
    r = contamination(spark.read.parquet(f"{awkward}/documents.parquet"), empty_like(benchmark(spark))).collect()
    assert len(r) == 21 and not any(x.contaminated or x.n_hit or x.n_items for x in r)


def test_a_benchmark_of_several_broadcasts(spark, awkward, monkeypatch):
    from tallyframe.llm import decontaminate
    docs, bench = spark.read.parquet(f"{awkward}/documents.parquet"), spark.read.parquet(f"{awkward}/benchmark.parquet")
    want = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    assert any("contaminated=True" in r for r in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 7)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == want
