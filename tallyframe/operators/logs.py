"""Log-table operators named by the planner's task documents."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholder forms in step arguments.
STEP_RESULT_PATTERN = r"\$\{steps\.([^.}]+)\.result\.([^}]+)\}"
SLOT_PATTERN = r"\$\{slots\.([^}]+)\}"


def log_query(logs: DataFrame, level: str, levels: Sequence[str], order: str, limit: int,
              fields: Sequence[str], tie: str | None = None) -> DataFrame:
    """rows whose level is in the set, newest first, first ``limit``,
    projected to ``fields`` (TakeOrderedAndProject: k rows per task)."""
    keys = [F.col(order).desc()] + ([F.col(tie).desc()] if tie else [])
    return logs.filter(F.col(level).isin(*levels)).orderBy(*keys).limit(limit).select(*fields)


def log_context(lines: DataFrame, keys: list[str], line_no: str, hit: Column, n: int) -> DataFrame:
    """Every line within ``n`` lines of a hit (same keys). Each hit
    expands to its 2n+1 neighbour numbers, de-duplicated and semi-joined
    back - no window over a whole file, so one huge log is no hot spot."""
    hits = lines.filter(hit).select(*keys, F.explode(F.sequence(F.col(line_no) - n, F.col(line_no) + n)).alias(line_no))
    return lines.join(hits.distinct(), keys + [line_no], "left_semi")


def placeholders(text: Column) -> Column:
    """``${steps.<label>.result.<field>}`` and ``${slots.<name>}``
    references in a text, as ``array<struct<kind, name, field>>``."""
    steps = F.transform(F.regexp_extract_all(text, F.lit(STEP_RESULT_PATTERN), 0), lambda m: F.struct(
        F.lit("step").alias("kind"), F.regexp_extract(m, STEP_RESULT_PATTERN, 1).alias("name"),
        F.regexp_extract(m, STEP_RESULT_PATTERN, 2).alias("field")))
    slots = F.transform(F.regexp_extract_all(text, F.lit(SLOT_PATTERN), 0), lambda m: F.struct(
        F.lit("slot").alias("kind"), F.regexp_extract(m, SLOT_PATTERN, 1).alias("name"),
        F.lit(None).cast("string").alias("field")))
    return F.concat(steps, slots)
