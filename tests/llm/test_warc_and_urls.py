import random
import re

import duckdb
import pytest

from tallyframe.llm import url_graph, warc
from tallyframe.llm.queries import QUERIES, op3_url_link_graph


def pages(spark):
    big = "<p>" + "é" * 700 + "</p>"
    return spark.createDataFrame([(1, "http://a/\r\nX: y", big, b"x"), (2, None, big, None), (None, "u", big, b"z"), (3, "v", None, None)],
                                 "page_id bigint, url string, html string, payload binary")


def test_records_are_exact_and_payloads_stored_once(spark, tmp_path):
    a = warc.write_archive(pages(spark), str(tmp_path / "a"))
    assert spark.read.parquet(a.payloads).count() == 2
    records = [bytes(r.record) for r in warc.read_archive(spark, a).collect()]
    assert len(records) == 4
    for rec in records:
        head, _, rest = rec.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and all(re.match(r"[A-Za-z-]+: ", x) for x in lines[1:])
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert rest == rest[:int(fields["Content-Length"])] + b"\r\n\r\n"
        assert (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields) == ("WARC-Profile" in fields)
    assert sum(b"WARC-Type: revisit" in r for r in records) == 2


def test_string_ids_come_back(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    ids = ["a", "", "p/1>", "é%0A%", "line\nbreak\r", None, "%", "%25", "12"]
    df = spark.createDataFrame([(i, "u", f"small {i}") for i in ids] + [("z\n1", "u", big), ("b", "u", big)], "page_id string, url string, html string")
    rows = warc.archived(df).collect()
    assert sorted((r.page_id is None, r.page_id or "") for r in rows) == sorted((i is None, i or "") for i in [*ids, "z\n1", "b"])
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {"b": "z\n1"} and all(r.verified for r in rows)


def test_damage_is_seen(spark, tmp_path):
    a = warc.write_archive(pages(spark), str(tmp_path / "b"))
    from pyspark.sql import functions as F
    bad = spark.read.parquet(a.payloads).withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(str(tmp_path / "c" / "payloads"))
    spark.read.parquet(a.headers).write.parquet(str(tmp_path / "c" / "headers"))
    assert not any(r.verified for r in warc.read_archive(spark, warc.Archive(str(tmp_path / "c"))).collect())


def page(i, url, *links):
    return (i, url, "".join(f"<a href='http://{x}/'>x</a>" for x in links))


PAGES = "page_id bigint, url string, html string"


def test_trust_and_distrust_spread(spark):
    df = spark.createDataFrame([
        page(1, "http://good.example.net/en/a", "friend.com", "mixed.com"), page(2, "http://bad.net/", "good.example.net"),
        page(3, "http://friend.com/", "friend2.com"), page(4, "http://friend2.com/x"), page(5, "http://spam.com/", "bad.net"),
        page(6, "http://spam2.com/", "spam.com"), page(7, "http://mixed.com/", "bad.net", "a.com", "b.com", "c.com", "d.com"), page(8, "http://alone.com/"),
        page(9, "http://de.example.com/de/x"), page(10, "http://de.example.com/en/x")], PAGES)
    got = {r.id: (r.rule, r.verdict) for r in url_graph.judge(df).collect()}
    assert got[1] == ("example.net/en/", "allow") and got[2] == ("net/", "block") and got[9] == ("example.com/de/", "block")
    assert [got[i][1] for i in (3, 4, 5, 6, 8, 10)] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert got[3][0] is None and got[10][0] is None


def test_a_host_is_a_seed_by_the_share_of_its_listed_pages(spark):
    rows = [page(i, f"http://few.example.com/{'de' if i < 2 else 'en'}/{i}") for i in range(20)]
    rows += [page(100 + i, f"http://most.example.com/{'de' if i < 15 else 'en'}/{i}") for i in range(20)]
    rows += [page(200, "http://to-few.com/", "few.example.com"), page(300, "http://to-most.com/", "most.example.com")]
    got = {r.id: (r.verdict, r.distrust) for r in url_graph.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == ("block", 0.1) and got[5] == ("allow", 0.1) and got[119] == ("block", 0.75)
    assert got[200] == got[300] == ("block", 1.0)  # they link to distrust and to nothing else


def settle(pairs, start, rounds=600):
    out = {}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    v = {h: 0.15 * s for h, s in start.items()}
    first = dict(v)
    for _ in range(rounds):
        nxt = dict(first)
        for a, b in pairs:
            nxt[b] = nxt.get(b, 0) + 0.85 * v.get(a, 0) / out[a]
        v = nxt
    return v


@pytest.mark.parametrize("rounds", [7, None])
def test_spread_equals_power_iteration(spark, rounds):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(20)]
    edges = sorted({(a, b) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(60)) if a != b})
    seeds = [("t", "h0", 0.5), ("t", "h1", 1.0), ("b", "h5", 0.25)]
    got = {r.host: (r.trust, r.distrust) for r in url_graph.spread(
        spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "kind string, host string, weight double"), rounds=rounds).collect()}
    t, b = settle(edges, {"h0": 0.5, "h1": 1.0}, rounds or 600), settle([(y, x) for x, y in edges], {"h5": 0.25}, rounds or 600)
    for h in hosts:
        for have, want in zip(got.get(h, (0, 0)), (t.get(h, 0), b.get(h, 0)), strict=True):
            assert abs(have - want) <= (1e-12 if rounds else 1e-5 * want)


def test_the_query_reaches_a_host_fifteen_links_away(spark, tmp_path):
    rows = [page(i, f"http://h{i}.com/", "bad.net" if i == 14 else f"h{i + 1}.com") for i in range(15)] + [page(99, "http://bad.net/")]
    rows += [page(200 + i, f"http://g{i}.com/", f"g{i + 1}.com") for i in range(15)] + [page(300, "http://a.org/fr/", "g0.com"), page(301, "http://g9.com/", "h3.com")]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.verdict for r in op3_url_link_graph(spark, str(tmp_path)).collect()}
    assert {got[i] for i in range(15)} == {"block"} and {got[200 + i] for i in range(9)} == {"allow"}
    pairs = [(f"h{i}", "bad" if i == 14 else f"h{i + 1}") for i in range(15)] + [(f"g{i}", f"g{i + 1}") for i in range(15)] + [("a", "g0"), ("g9", "h3")]
    t, b = settle(pairs, {"a": 1.0}), settle([(y, x) for x, y in pairs], {"bad": 1.0})
    for i in range(15):
        assert got[200 + i] == ("block" if b.get(f"g{i}", 0) > t.get(f"g{i}", 0) else "allow")


def test_the_sql_spreads_alike(spark, tmp_path):
    rng = random.Random(4)
    hosts = ["a.net", "b.example.net", "c.org", "d.com", "e.com", "f.com", "x.example.com", "g.com", "h.com"]
    rows = [page(i, f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'fr/', ''])}{i}", *rng.sample(hosts, rng.randint(0, 2))) for i in range(60)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.host, r.verdict, r.rule, round(r.distrust or 0, 3)) for r in op3_url_link_graph(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, host, verdict, rule, round(coalesce(distrust, 0), 3) from ({QUERIES['op3_url_link_graph'][1]})").fetchall()
    assert str(got) == str(sorted(want)) and len({r[4] for r in got}) > 3
