"""Versioned state as long-form change tables.

A change row is ``(entity, seq, kind, key, value)``: ``set`` replaces a
scalar, ``set_map`` replaces one map entry, ``append`` adds to a list;
unknown kinds are ignored. State never travels as one document: scalars and
map entries are reduced with ``max_by`` (partial aggregation), list items
stay rows ordered by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Change kinds.
KINDS_SET = ("set", "set_map")
KIND_APPEND = "append"


def replay_events(changes: DataFrame, entity: str = "entity", seq: str = "seq", kind: str = "kind",
                  key: str = "key", value: str = "value") -> DataFrame:
    """V5: current state - last write wins per (entity, key) for set kinds;
    every append kept as an item row. Output ``(entity, key, kind, seq,
    value)``."""
    sets = changes.filter(F.col(kind).isin(*KINDS_SET)).groupBy(entity, key).agg(
        F.max_by(F.struct(F.col(kind), F.col(seq), F.col(value)), F.col(seq)).alias("__w"))
    sets = sets.select(entity, key, F.col(f"__w.{kind}").alias(kind), F.col(f"__w.{seq}").alias(seq),
                       F.col(f"__w.{value}").alias(value))
    items = changes.filter(F.col(kind) == KIND_APPEND).select(entity, key, kind, seq, value)
    return sets.unionByName(items)


def as_of_version(changes: DataFrame, version, seq: str = "seq", **kw) -> DataFrame:
    """V6: state before later batches - replay of the changes with
    ``seq <= version``."""
    return replay_events(changes.filter(F.col(seq) <= F.lit(version)), seq=seq, **kw)


def scalar_view(state: DataFrame, entity: str = "entity", key: str = "key", kind: str = "kind",
                seq: str = "seq", value: str = "value") -> DataFrame:
    """One comparable value per (entity, key): set values as is; a list is
    summarised by its item count and last item (no array is built)."""
    sets = state.filter(F.col(kind) != KIND_APPEND).select(entity, key, F.col(value).alias("value"))
    lists = state.filter(F.col(kind) == KIND_APPEND).groupBy(entity, key).agg(
        F.concat(F.lit("list["), F.count(F.lit(1)).cast("string"), F.lit("]:"),
                 F.md5(F.coalesce(F.max_by(F.col(value), F.col(seq)), F.lit("")))).alias("value"))
    return sets.unionByName(lists)


def diff_snapshots(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys of either side whose values differ (missing = null) as
    ``from`` / ``to``."""
    x = a.select(*keys, F.col(value).alias("from"))
    y = b.select(*keys, F.col(value).alias("to"))
    j = x.join(y, keys, "full_outer")
    return j.filter(~F.col("from").eqNullSafe(F.col("to")))


def union_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the key sets."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def check_expected(state: DataFrame, expected: DataFrame, entity: str, key: str, value: str = "value") -> DataFrame:
    """V4: per entity, passed when every expected key equals the state
    (null-safe) and the number of mismatching keys; an entity with no
    expectation passes. ``expected_mismatches`` lists the keys themselves."""
    e = expected.select(entity, key, F.col(value).alias("expected"))
    s = state.select(entity, key, F.col(value).alias("current"))
    j = e.join(s, [entity, key], "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("current")))
    per = j.groupBy(entity).agg(F.every("ok").alias("passed"),
                                F.count_if(~F.col("ok")).cast("bigint").alias("n_mismatch"))
    ents = state.select(entity).union(expected.select(entity)).distinct()
    return ents.join(per, entity, "left").select(
        entity, F.coalesce(F.col("passed"), F.lit(True)).alias("passed"),
        F.coalesce(F.col("n_mismatch"), F.lit(0)).cast("bigint").alias("n_mismatch"))


def expected_mismatches(state: DataFrame, expected: DataFrame, entity: str, key: str,
                        value: str = "value") -> DataFrame:
    """V4 detail: the mismatching (entity, key) rows with expected and
    current values."""
    e = expected.select(entity, key, F.col(value).alias("expected"))
    s = state.select(entity, key, F.col(value).alias("current"))
    return e.join(s, [entity, key], "left").filter(~F.col("expected").eqNullSafe(F.col("current")))


#: State store of the operators with keyed state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Changes of an entity's current run that can be undone.
MAX_UNDO = 1000


def keyed_state(spark: SparkSession) -> None:
    """Let streams started from now on keep their state in RocksDB, which
    ``transformWithState`` needs: state beyond memory, one entry per cell."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Replay(StatefulProcessor):
    """R6 body. ``cells``: key -> (value, length of a list or null), one entry
    per live cell. ``undo``: number -> (key, the cell before the change), of
    which ``ends`` names the first and the next number; older entries go."""

    def __init__(self, max_undo: int):
        self.max_undo = max_undo

    def init(self, handle) -> None:
        self.cells = handle.getMapState("cells", "key string", "value string, length int")
        self.undo = handle.getMapState("undo", "number long", "key string, was boolean, value string, length int")
        self.ends = handle.getValueState("ends", "first long, next long")

    def _put(self, key: str, cell: tuple | None) -> None:
        if cell is not None:
            self.cells.updateValue((key,), cell)
        elif self.cells.containsKey((key,)):
            self.cells.removeKey((key,))

    def handleInputRows(self, key, rows, timerValues):
        first, nxt = tuple(self.ends.get()) if self.ends.exists() else (0, 0)
        # the shuffle does not keep the order of a micro-batch; what is sorted is this entity's part of it
        for r in sorted(rows, key=lambda r: r.seq):
            touched = "" if r.key is None else "=" + r.key
            if r.kind == "begin":
                for number in range(first, nxt):
                    self.undo.removeKey((number,))
                first = nxt
                continue
            if r.kind == "undo":
                if nxt > first:
                    nxt -= 1
                    touched, was, value, length = tuple(self.undo.getValue((nxt,)))
                    self.undo.removeKey((nxt,))
                    self._put(touched, (value, length) if was else None)
            elif r.kind in (*KINDS_SET, KIND_APPEND):
                was = self.cells.containsKey((touched,))
                value, length = tuple(self.cells.getValue((touched,))) if was else (None, None)
                self.undo.updateValue((nxt,), (touched, was, value, length))
                nxt += 1
                if nxt - first > self.max_undo:
                    self.undo.removeKey((first,))
                    first += 1
                self._put(touched, (r.value, None) if r.kind != KIND_APPEND else (None, 1 + (length if length is not None else int(was))))
            else:
                continue
            now = tuple(self.cells.getValue((touched,))) if self.cells.containsKey((touched,)) else (None, None)
            yield Row(entity=key[0], seq=r.seq, depth=nxt - first, key=touched[1:] if touched else None, value=now[0], list_len=now[1])
        self.ends.update((first, nxt))

    def close(self) -> None:
        pass


def stateful_replay(changes: DataFrame, entity: str = "entity", max_undo: int = MAX_UNDO) -> DataFrame:
    """Streaming replay with undo on ``transformWithState``: one row per
    applied change with the touched key, its new scalar value or the new length
    of a list, and the ``depth`` of the undo list.

    The state of an entity is one entry per live key and one per change that
    can still be undone: the last ``max_undo`` ones of the current run, which a
    change of kind ``begin`` starts anew. A long history leaves nothing else."""
    keyed_state(changes.sparkSession)
    d = changes.select(F.col(entity).alias("entity"), F.col("seq").cast("long").alias("seq"), "kind", "key", "value")
    kind = d.schema["entity"].dataType.simpleString()
    return d.groupBy("entity").transformWithState(
        _Replay(max_undo), f"entity {kind}, seq long, depth int, key string, value string, list_len int", "append", "None")
