"""MON: streams drained with AvailableNow agree with batch forms; state ops."""

import datetime as dt
import json
import os


from tallyframe.operators import state as S
from tallyframe.streaming import events as E


def _absence(spark, tmp_path, files, per_batch=None, runs=1):
    """Alerts of the stream over ``files`` (one list of (slot, name) each) and of the batch form."""
    base = dt.datetime(2024, 1, 1)
    src = tmp_path / "ev"
    src.mkdir()
    for i, rows in enumerate(files):
        f = src / f"f{i}.json"
        f.write_text("\n".join(json.dumps({"ts": (base + dt.timedelta(seconds=30 * s + 3)).isoformat(), "name": n}) for s, n in rows))
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    schema = "ts timestamp, name string"
    out = "file:" + str(tmp_path / "log")
    for run in range(runs):
        stream = E.event_stream(spark, "file:" + str(src), schema, fmt="json", max_files_per_trigger=per_batch)
        E.absence_stream(stream, "ts", "name", out, str(tmp_path / "ck"), 30)
    got = sorted(tuple(r) for r in E.read_absences(spark, out, 30).collect())
    batch = sorted(tuple(r) for r in E.absence_alerts(spark.read.schema(schema).json(str(src)), "ts", "name", 30).collect())
    slots = [(n, int((w - base).total_seconds()) // 30) for n, w, _ in batch]
    return got, batch, slots


def test_absence_stream_equals_batch(spark, tmp_path):
    rows = [(s, "svc") for s in (0, 1, 2, 5, 6, 9)] + [(s, "db") for s in range(0, 10, 2)]
    got, batch, slots = _absence(spark, tmp_path, [rows])
    assert got == batch and [x for n, x in slots if n == "svc"] == [3, 4, 7, 8]


def test_absence_of_a_process_that_never_returns_and_of_any_length(spark, tmp_path):
    files = [[(0, "gone"), (0, "svc"), (1, "svc")], [(2, "svc"), (3, "late"), (4, "svc")], [(100, "svc")], [(181, "late"), (181, "svc")]]
    got, batch, slots = _absence(spark, tmp_path, files, per_batch=1, runs=2)
    assert got == batch
    assert [x for n, x in slots if n == "gone"] == list(range(1, 182)) and len([x for n, x in slots if n == "late"]) == 177


def test_upsert_stream_survives_second_runs_and_replays(spark, tmp_path):
    from tallyframe.sources import files as S2
    from tallyframe.sources import versions as V
    root, src = "file:" + str(tmp_path / "table"), tmp_path / "up"
    schema = "id string, payload string, seq long"
    S2.init_bucketed_table(spark.createDataFrame([("a", "0", 0), ("b", "0", 0)], schema), root)
    for run in range(3):
        spark.createDataFrame([("a", str(run + 1), run), (f"n{run}", "x", 0)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = E.event_stream(spark, str(src), schema, max_files_per_trigger=1)
        S2.upsert_stream(stream, root, str(tmp_path / ("same" if run < 2 else "fresh")))
    rows = {r.id: r.payload for r in S2.read_bucketed_table(spark, root).collect()}
    assert set(rows) == {"a", "b", "n0", "n1", "n2"} and rows["b"] == "0" and rows["a"] in "123"
    # a replayed epoch of the last query is left out
    root += "/commits"
    found = V.versions(spark, root)
    number, query, epoch, _ = found[-1]
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", query)
    try:
        assert V.is_written(spark, root, epoch) and not V.is_written(spark, root, epoch + 1)
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert [n for n, *_ in found] == list(range(len(found)))


def test_an_upsert_rewrites_the_touched_buckets_only(spark, tmp_path):
    from tallyframe.sources import files as S2
    from tallyframe.sources import versions as V
    root, src = "file:" + str(tmp_path / "table"), tmp_path / "up"
    schema = "id string, payload string, seq long"
    S2.init_bucketed_table(spark.range(3000).selectExpr("cast(id as string) id", "'old' payload", "0L seq"), root, buckets=16)
    before = {r.bucket: r.folder for r in V.read_latest(spark, f"{root}/commits").collect()}
    spark.createDataFrame([("17", "a", 1), ("17", "b", 2), ("new", "c", 1)], schema).coalesce(1).write.parquet(str(src))
    S2.upsert_stream(E.event_stream(spark, str(src), schema), root, str(tmp_path / "ck"))
    rows = {r.id: r.payload for r in S2.read_bucketed_table(spark, root).collect()}
    assert len(rows) == 3001 and rows["17"] == "b" and rows["new"] == "c" and sum(v == "old" for v in rows.values()) == 2999
    after = {r.bucket: r.folder for r in V.read_latest(spark, f"{root}/commits").collect()}
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and len(after) == 17
    written = spark.read.parquet(*{f"{root}/{after[b]}" for b in changed}).count()
    assert written < 3000 * 3 / 16 + 200
    # an empty table takes its first rows
    empty = "file:" + str(tmp_path / "empty")
    S2.init_bucketed_table(spark.createDataFrame([], schema), empty)
    assert S2.read_bucketed_table(spark, empty).count() == 0
    S2.upsert_stream(E.event_stream(spark, str(src), schema), empty, str(tmp_path / "ck2"))
    assert {r.id: r.payload for r in S2.read_bucketed_table(spark, empty).collect()} == {"17": "b", "new": "c"}


def test_breach_edges(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 10.5)], "name string, total double")
    assert [r.name for r in E.breach_alerts(df, 10.0).collect()] == ["b"]
    assert E.breach_alerts(df, 0).count() == 0


def test_replay_and_as_of(spark):
    ch = spark.createDataFrame([(1, 1, "set", "clip", "a"), (1, 2, "set", "clip", "b"), (1, 3, "append", "logs", "x"),
                                (1, 4, "append", "logs", "y"), (1, 5, "bogus", "clip", "z")],
                               "entity long, seq long, kind string, key string, value string")
    cur = {(r.key, r.seq): r.value for r in S.replay_events(ch).collect()}
    assert cur == {("clip", 2): "b", ("logs", 3): "x", ("logs", 4): "y"}
    old = {(r.key, r.value) for r in S.as_of_version(ch, 1).collect()}
    assert old == {("clip", "a")}
    d = S.diff_snapshots(S.scalar_view(S.as_of_version(ch, 1)), S.scalar_view(S.replay_events(ch)), ["entity", "key"])
    assert sorted(r.key for r in d.collect()) == ["clip", "logs"]


def test_check_expected(spark):
    st = spark.createDataFrame([(1, "clip", "a"), (2, "clip", "b")], "entity long, key string, value string")
    ex = spark.createDataFrame([(1, "clip", "a"), (2, "clip", "zz")], "entity long, key string, value string")
    got = {r.entity: r.passed for r in S.check_expected(st, ex, "entity", "key").collect()}
    assert got == {1: True, 2: False}


def test_stateful_replay_undo(spark, tmp_path):
    rows = [(1, 1, "set", "clip", "a"), (1, 2, "append", "logs", "x"), (1, 3, "append", "logs", "y"),
            (1, 4, "undo", None, None), (1, 5, "set", "clip", "b"), (1, 6, "undo", None, None),
            (1, 7, "undo", None, None)]
    src = tmp_path / "changes"
    spark.createDataFrame(rows, "entity long, seq long, kind string, key string, value string").write.parquet(str(src))
    stream = E.event_stream(spark, str(src), "entity long, seq long, kind string, key string, value string")
    out = sorted(tuple(r) for r in E.run_available_now(S.stateful_replay(stream), "append", "t-r6").collect())
    assert [(s, d, k, v, n) for _, s, d, k, v, n in out] == [
        (1, 1, "clip", "a", None), (2, 2, "logs", None, 1), (3, 3, "logs", None, 2), (4, 2, "logs", None, 1),
        (5, 3, "clip", "b", None), (6, 2, "clip", "a", None), (7, 1, "logs", None, None)]


def test_stateful_replay_keeps_live_cells_only_and_survives_restarts(spark, tmp_path):
    schema = "entity long, seq long, kind string, key string, value string"
    src, seq = tmp_path / "changes", 0
    for batch in range(3):
        rows = []
        for i in range(40):
            seq += 1
            rows.append((1, seq, "set", f"k{i % 2}", str(seq)))
        rows.append((1, seq + 1, "set", None, "none"))
        rows += [(1, seq + 2 + j, "undo", None, None) for j in range(7)]
        rows += [(2, seq + 20, "set", "a", "x"), (2, seq + 21, "begin", None, None), (2, seq + 22, "undo", None, None), (2, seq + 23, "noop", "a", "y")]
        seq += 30
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = S.stateful_replay(E.event_stream(spark, str(src), schema), max_undo=5)
        got = E.run_available_now(stream, "append", "t-r6").where("entity = 1").orderBy("seq").collect()
        assert max(r.depth for r in got) == 5
        # of the eight changes only five can be undone, then undo finds nothing
        last = [(r.depth, r.key, r.value) for r in got[-7:]]
        assert last[0] == (4, None, None) and [d for d, *_ in last] == [4, 3, 2, 1, 0, 0, 0]
        assert [v for _, k, v in last[1:5]] == [str(int(r.value) - 2) if int(r.value) > 2 else None for r in reversed(got[-12:-8])]
    ck = str(tmp_path / "ck")
    for part in range(2):  # a second run from the same checkpoint goes on with the same state
        folder = tmp_path / "more"
        spark.createDataFrame([(9, 10 * part + 1, "append", "l", "x"), (9, 10 * part + 2, "set", "c", str(part))], schema).coalesce(1).write.mode("append").parquet(str(folder))
        out = str(tmp_path / f"out{part}")
        w = S.stateful_replay(E.event_stream(spark, str(folder), schema)).writeStream.foreachBatch(lambda b, e, out=out: b.write.mode("append").parquet(out))
        w.option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r.seq, r.depth, r.key, r.value, r.list_len) for r in spark.read.parquet(out).collect())
    assert rows == [(11, 3, "l", None, 2), (12, 4, "c", "1", None)]


def test_json_event_stream_watermark_append(spark, tmp_path):
    """R1 over JSON lines + R2 in append mode: a window is emitted once the
    watermark passes it; rows behind the watermark are dropped."""
    import json
    src = tmp_path / "events"
    src.mkdir()
    base = dt.datetime(2024, 1, 1)
    first = [{"ts": (base + dt.timedelta(seconds=s)).isoformat(), "name": "svc", "rss": 10.0} for s in (1, 5, 31, 65, 200)]
    (src / "a.json").write_text("\n".join(json.dumps(e) for e in first))
    later = [{"ts": (base + dt.timedelta(seconds=s)).isoformat(), "name": "svc", "rss": 1.0} for s in (10, 250)]
    (src / "b.json").write_text("\n".join(json.dumps(e) for e in later))
    latest = [{"ts": (base + dt.timedelta(seconds=s)).isoformat(), "name": "svc", "rss": 100.0} for s in (100, 300)]
    (src / "c.json").write_text("\n".join(json.dumps(e) for e in latest))
    import os
    t0 = os.path.getmtime(src / "a.json")
    os.utime(src / "b.json", (t0 + 5, t0 + 5))
    os.utime(src / "c.json", (t0 + 10, t0 + 10))
    stream = E.event_stream(spark, str(src), "ts timestamp, name string, rss double", fmt="json",
                            max_files_per_trigger=1)
    totals = E.windowed_totals(stream, "ts", "name", "rss", "30 seconds", "40 seconds")
    out = E.run_available_now(totals, "append", "t-wm")
    got = sorted((r.window_start.second + 60 * r.window_start.minute, r.total) for r in out.collect())
    # Spark filters late rows with the previous batch's watermark: batch 1
    # (a.json) ends at 200 - 40 = 160 s; in batch 2 the 10 s event is still
    # accepted (late-row watermark 0) and windows up to 160 s close; in batch 3
    # the 100 s event is behind 160 s and dropped, so [90, 120) never appears
    assert got == [(0, 21.0), (30, 10.0), (60, 10.0), (180, 10.0)]


def test_breach_stream_marker_and_log(spark, tmp_path):
    import json
    src = tmp_path / "ev"
    src.mkdir()
    base = dt.datetime(2024, 1, 1)
    files = [[(5, "a", 60.0), (70, "a", 10.0)], [(8, "a", 50.0), (75, "b", 200.0)], [(400, "a", 1.0)]]
    import os
    for i, evs in enumerate(files):
        f = src / f"f{i}.json"
        f.write_text("\n".join(json.dumps({"ts": (base + dt.timedelta(seconds=s)).isoformat(), "name": n, "rss": r})
                               for s, n, r in evs))
        os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = E.event_stream(spark, str(src), "ts timestamp, name string, rss double", fmt="json", max_files_per_trigger=1)
    totals = E.windowed_totals(stream, "ts", "name", "rss", "1 minute", "10 minutes")
    log, marker = str(tmp_path / "log"), str(tmp_path / "marker")
    E.breach_stream(totals, 100.0, log, marker, str(tmp_path / "ck"))
    E.breach_stream(totals, 100.0, log, marker, str(tmp_path / "ck"))  # a second start from the same checkpoint adds nothing
    logged = sorted((r.name, r.window_start.minute, r.total) for r in spark.read.parquet(log).collect())
    # window a@[0,60) crosses 100 only after the second file (60 + 50)
    assert logged == [("a", 0, 110.0), ("b", 1, 200.0)]
    m = sorted((r.name, r.window_start.minute, r.total) for r in E.read_marker(spark, marker).collect())
    assert m == [("a", 0, 110.0), ("b", 1, 200.0)]
