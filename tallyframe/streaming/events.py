"""Event-log streams and resource alerts.

Streams are Structured Streaming queries; ``run_available_now`` drives one
to completion with ``Trigger.AvailableNow`` and lands its result in a table
under the shared checkpoint folder (never driver memory), so registered
queries can return an ordinary DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tallyframe.operators.state import keyed_state
from tallyframe.session import scratch_path
from tallyframe.sources import versions as V

DEFAULT_POLL = "30 seconds"
MIN_POLL_SECONDS = 1


def event_stream(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet",
                 glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Tail an append-only folder of event files (parquet or JSON
    lines); ``glob`` restricts which file names belong to the stream."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def utc_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Cast a TIMESTAMP_NTZ event time to TIMESTAMP so watermarks accept it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_available_now(stream: DataFrame, mode: str = "append", name: str = "stream",
                      key_cols: list[str] | None = None) -> DataFrame:
    """Run a streaming DataFrame until its input is drained and return the
    result as a batch DataFrame read back from shared storage.

    Every micro-batch is a folder of its own, so a replayed batch writes over
    itself. ``append``: all rows; ``update`` with ``key_cols``: the last
    version of every key, which needs no state beyond the watermark."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/__epoch=-1")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/__epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    log = spark.read.parquet(out)
    if key_cols:
        latest = log.groupBy(*key_cols).agg(F.max("__epoch").alias("__last"))
        log = log.join(latest, key_cols).filter(F.col("__epoch") == F.col("__last")).drop("__last")
    return log.drop("__epoch")


def windowed_totals(events: DataFrame, ts: str, name: str, value: str, poll: str = DEFAULT_POLL,
                    watermark: str | None = "1 hour", pid: str | None = None) -> DataFrame:
    """R2/A4: total value per tumbling poll window and (lower-cased) process
    name, with the sample count and, when ``pid`` is given, the number of
    distinct pids. Works on streams (watermarked) and batches alike; partial
    aggregation keeps every group's state to a few numbers."""
    d = events.withWatermark(ts, watermark) if watermark and events.isStreaming else events
    aggs = [F.sum(value).alias("total"), F.count(F.lit(1)).cast("bigint").alias("n_samples"),
            F.max(value).alias("peak")]
    if pid and not events.isStreaming:
        aggs.append(F.count_distinct(pid).cast("bigint").alias("n_pids"))
    g = d.groupBy(F.window(ts, poll).alias("w"), F.lower(F.col(name)).alias("name")).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name",
                    *[c for c in g.columns if c not in ("w", "name")])


def rss_total(samples: DataFrame, poll_col: str, name_col: str, process: str, rss: str, pid: str) -> DataFrame:
    """A4: per poll, the summed RSS and the number of distinct pids of one
    process name (case-insensitive); polls without it report 0. The pid list
    itself is ``rss_pids`` (long form), so no poll's list is gathered into
    one value."""
    polls = samples.select(poll_col).distinct()
    hit = samples.filter(F.lower(F.col(name_col)) == process.lower()).groupBy(poll_col).agg(
        F.sum(rss).alias("rss_mb"), F.count_distinct(pid).cast("bigint").alias("n_pids"))
    j = polls.join(hit, poll_col, "left")
    return j.select(poll_col, F.coalesce(F.col("rss_mb"), F.lit(0.0)).alias("rss_mb"),
                    F.coalesce(F.col("n_pids"), F.lit(0)).cast("bigint").alias("n_pids"))


def rss_pids(samples: DataFrame, poll_col: str, name_col: str, process: str, pid: str) -> DataFrame:
    """A4 pid list in long form: one row per (poll, pid) of the process."""
    return samples.filter(F.lower(F.col(name_col)) == process.lower()).select(poll_col, pid).distinct()


def breach_alerts(totals: DataFrame, limit: float, total: str = "total") -> DataFrame:
    """Windows whose total is strictly above the limit; a limit <= 0
    disables alerts (no rows)."""
    if limit <= 0:
        return totals.filter(F.lit(False))
    return totals.filter(F.col(total) > F.lit(float(limit)))


def latest_breach(breaches: DataFrame, name: str = "name", start: str = "window_start",
                  total: str = "total") -> DataFrame:
    """R3 marker: only the newest breach per name (``max_by``)."""
    return breaches.groupBy(name).agg(F.max_by(F.struct(F.col(start), F.col(total)), F.col(start)).alias("m")) \
        .select(name, F.col(f"m.{start}").alias(start), F.col(f"m.{total}").alias(total))


def _slots(events: DataFrame, ts: str, name: str, poll_seconds: int) -> DataFrame:
    step = max(MIN_POLL_SECONDS, int(poll_seconds))
    return events.select(F.col(name).alias("name"), (F.floor(F.unix_timestamp(ts) / step) * step).cast("bigint").alias("slot")).distinct()


def _alerts(missing: DataFrame) -> DataFrame:
    return missing.select("name", F.timestamp_seconds("slot").alias("window_start"), F.lit("start").alias("action"))


def absence_alerts(polls: DataFrame, ts: str, name: str, poll_seconds: int = 30) -> DataFrame:
    """R4 (batch): for each name, every poll window after its first sighting,
    up to the latest poll of any name, in which it was not seen -> a start
    action; a process that never comes back is reported at every poll.
    Expected windows come from ``sequence`` per name (bounded by the time
    span), observed ones are removed by an anti join."""
    step = max(MIN_POLL_SECONDS, int(poll_seconds))
    seen = _slots(polls, ts, name, step)
    latest = seen.select(F.max("slot")).scalar()
    first = seen.groupBy("name").agg(F.min("slot").alias("lo"))
    expected = first.select("name", F.explode(F.sequence("lo", latest, F.lit(step).cast("bigint"))).alias("slot"))
    return _alerts(expected.join(seen, ["name", "slot"], "left_anti"))


class _Absence(StatefulProcessor):
    """R4 body, one per name: the poll up to which it is ``closed`` (and
    whether a timer has closed one), and the later polls it was seen in. The
    timer of the next poll's end closes that poll and all later ones that the
    watermark has passed."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "slot long, fired boolean")
        self.seen = handle.getMapState("seen", "slot long", "at long")

    def _wait(self, closed: int) -> None:
        self.handle.registerTimer((closed + 2 * self.step) * 1000)

    def handleInputRows(self, key, rows, timerValues):
        slots = sorted({r.slot for r in rows})
        closed, fired = tuple(self.closed.get()) if self.closed.exists() else (slots[0] - self.step, False)
        if not fired:
            closed = min(closed, slots[0] - self.step)
        for slot in slots:
            if slot > closed and not self.seen.containsKey((slot,)):
                self.seen.updateValue((slot,), (slot,))
                yield Row(name=key[0], slot=slot, action="seen")
        self.closed.update((closed, fired))
        self._wait(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, (closed, _) = timerValues.getCurrentWatermarkInMs(), tuple(self.closed.get())
        while (closed + 2 * self.step) * 1000 <= now:
            closed += self.step
            if self.seen.containsKey((closed,)):
                self.seen.removeKey((closed,))
            else:
                yield Row(name=key[0], slot=closed, action="start")
        self.closed.update((closed, True))
        self._wait(closed)

    def close(self) -> None:
        pass


def absence_stream(events: DataFrame, ts: str, name: str, log_path: str, checkpoint: str, poll_seconds: int = 30,
                   delay: str = "0 seconds", once: bool = True):
    """R4 (stream): a log of polls per name, ``seen`` or a ``start`` action
    where a name was expected and not seen, however long the gap.

    Every name has an event-time timer at the end of its next open poll, so a
    name that never returns is reported at every poll, and a batch touches the
    names it holds and those whose polls the watermark closes. ``delay`` is how
    much later than a newer event one may come; sightings in closed polls come
    too late. A batch's log is a folder of its own: a replayed batch writes
    over itself."""
    step = max(MIN_POLL_SECONDS, int(poll_seconds))
    keyed_state(events.sparkSession)
    slots = events.withWatermark(ts, delay).select(ts, F.col(name).alias("name"), (F.floor(F.unix_timestamp(ts) / step) * step).cast("bigint").alias("slot"))
    log = slots.groupBy("name").transformWithState(_Absence(step), "name string, slot long, action string", "append", "EventTime")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/query={V.query_id(batch.sparkSession)}/epoch={epoch}")

    q = log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = (q.trigger(availableNow=True) if once else q).start()
    if once:
        q.awaitTermination()
    return q


def read_absences(spark: SparkSession, log_path: str, poll_seconds: int = 30, delay_seconds: int = 0) -> DataFrame:
    """The alerts logged so far and, as of now, those of the polls that the
    watermark has not closed: they lie within the delay and two polls of the
    newest one."""
    step = max(MIN_POLL_SECONDS, int(poll_seconds))
    if not V.exists(spark, log_path):
        return spark.createDataFrame([], "name string, window_start timestamp, action string")
    log = spark.read.schema("name string, slot long, action string").option("recursiveFileLookup", "true").parquet(log_path)
    newest = log.select(F.max("slot")).scalar()
    oldest = F.floor((newest - delay_seconds) / step) * step - 2 * step
    first = log.groupBy("name").agg(F.min("slot").alias("lo")).withColumn("lo", F.greatest("lo", oldest.cast("bigint")))
    last = first.where(F.col("lo") <= newest).select("name", F.explode(F.sequence("lo", newest, F.lit(step).cast("bigint"))).alias("slot"))
    return _alerts(log.where("action = 'start'").select("name", "slot").unionByName(last.join(log, ["name", "slot"], "left_anti")))


def event_counts(events: DataFrame, kind: str = "event") -> DataFrame:
    """Number of log lines per event kind."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def append_events(df: DataFrame, path: str, ts: Column | None = None) -> None:
    """Append one JSON object per line; a ``timestamp`` (UTC) is added
    unless the event carries its own."""
    out = df if "timestamp" in df.columns else df.withColumn(
        "timestamp", F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    out.write.mode("append").json(path)


def decision_log(samples: DataFrame, value: str, choice: str = "variant", reason: str = "reason") -> DataFrame:
    """One decision record per selection (value, choice, reason)."""
    return samples.select(F.col(value).alias("value"), F.col(choice).alias("choice"), F.col(reason).alias("reason"))


def decision_stream(samples_stream: DataFrame, choose: Callable[[DataFrame], DataFrame], value: str, log_path: str, checkpoint: str, once: bool = True):
    """R7 as a running stream: every micro-batch of samples is decided by
    ``choose`` (J6) and its decision records are appended to the JSON-lines
    log, one folder per epoch, so that a replayed batch writes over itself."""
    def sink(batch: DataFrame, epoch: int) -> None:
        decision_log(choose(batch), value).write.mode("overwrite").json(f"{log_path}/query={V.query_id(batch.sparkSession)}/epoch={epoch}")

    q = samples_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = (q.trigger(availableNow=True) if once else q).start()
    if once:
        q.awaitTermination()
    return q


def breach_stream(totals_stream: DataFrame, limit: float, log_path: str, marker_path: str,
                  checkpoint: str, total: str = "total", name: str = "name",
                  start: str = "window_start", once: bool = True):
    """R3 as a running stream: window totals in update mode; every micro-batch
    writes its breaches (strictly above ``limit``; ``limit <= 0`` disables)
    to its own folder of the log table, and the versioned marker table keeps
    only the newest breach per name. A replayed batch writes over its folder
    and leaves the marker as it is."""
    def newest_per_name(df: DataFrame) -> DataFrame:
        # a window re-emitted in a later batch (update mode) supersedes itself
        m = df.groupBy(name).agg(F.max_by(F.struct(start, total, "epoch"), F.struct(start, "epoch")).alias("m"))
        return m.select(name, "m.*")

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        br = breach_alerts(batch, limit, total).select(name, start, total)
        br.write.mode("overwrite").parquet(f"{log_path}/query={V.query_id(spark)}/epoch={epoch}")
        if V.is_written(spark, marker_path, epoch):
            return
        prev = V.read_latest(spark, marker_path)
        br = br.withColumn("epoch", F.lit(epoch).cast("bigint"))
        V.write_version(newest_per_name(br if prev is None else br.unionByName(prev)), marker_path, epoch)

    q = (totals_stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    q = (q.trigger(availableNow=True) if once else q).start()
    if once:
        q.awaitTermination()
    return q


def read_marker(spark: SparkSession, marker_path: str) -> DataFrame:
    """The newest breach per name written by ``breach_stream``."""
    m = V.read_latest(spark, marker_path)
    return spark.createDataFrame([], "name string, window_start timestamp, total double") if m is None else m


__all__ = ["event_stream", "utc_event_time", "run_available_now", "windowed_totals", "rss_total",
           "breach_alerts", "latest_breach", "absence_alerts", "absence_stream", "event_counts",
           "append_events", "read_absences", "decision_stream", "decision_log", "rss_pids", "breach_stream", "read_marker"]
