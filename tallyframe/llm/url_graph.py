"""URL filter with trust and distrust spread over the host graph.

Listed rules decide the urls they fit. For the others the verdict is the
host's: personalised PageRank from the hosts of allowed urls along links gives
trust, the same from the hosts of blocked urls against the links gives
distrust. A host is a seed by the share of its own pages that rules list, and
those of its pages that no rule lists are neutral evidence of the same kind: a
host is blocked where distrust makes up more than ``THRESHOLD`` of trust,
distrust and the neutral share of a host that has listed pages. The graph is a
table of distinct host pairs, and a round is one equi-join and one grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written

#: (verdict, host, path): fixed by the task.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Largest relative change of any host's value over ``CHUNK`` rounds at which the spread has settled.
TOLERANCE = 1e-6
CHUNK = 5
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or scheme-relative link.
_HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, else nulls. Of rules
    of one length the one with the longer host comes first, then a block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links ``(src, dst)`` between different hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(_HREF), 1)
    e = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    return e.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` of every host that gets any.

    ``seeds`` has ``(kind, host, weight)``, kind ``t`` or ``b``, one row per
    kind and host; a seed gives ``1 - damping`` of its weight in every round.
    Mass that reaches a host without links on is lost. Rounds go on until no
    host is newly reached and no value changes by more than ``TOLERANCE`` of
    itself, however far a host lies from the seeds; a given number of
    ``rounds`` is run as it is.
    """
    start = written(seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("v")), "seeds")
    edges = written(edges, "edges")
    state = start
    if edges.take(1):
        out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        forth = edges.join(out, "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.lit(1.0) / F.col("n")).alias("w"))
        back = edges.join(into, "dst").select(F.lit("b").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.lit(1.0) / F.col("n")).alias("w"))
        flows = written(forth.unionByName(back), "flows")
        before, step = start, 0
        while rounds is None or step < rounds:
            step += 1
            moved = flows.join(state, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("v") * F.col("w") * damping).alias("v"))
            state = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("v").alias("v"))
            if step % CHUNK == 0:
                state = written(state, "spread")
                if rounds is None:
                    was = before.select("kind", "host", F.col("v").alias("was"))
                    moves = F.col("was").isNull() | (F.abs(F.col("v") - F.col("was")) > F.col("v") * TOLERANCE)
                    if not state.join(was, ["kind", "host"], "left").where(moves).take(1):
                        break
                    before = state
    return state.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("v")).otherwise(0.0)).alias("trust"),
                                     F.sum(F.when(F.col("kind") == "b", F.col("v")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          threshold: float = THRESHOLD, rounds: int | None = None) -> DataFrame:
    """One row per row of ``pages``: ``id``, ``host``, ``path``, ``rule``,
    ``verdict`` and the host's ``distrust`` share (null where it gets none).

    A null url or one without ``://`` has empty host and path, no rule and is
    allowed, as is a host that neither trust nor distrust reaches. Null and
    empty pages have no links; repeated rows stay, and count in their host's
    shares; extra columns are not read.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)

    def share(what: str) -> Column:
        return F.avg(F.when(F.col("listed") == what, 1.0).otherwise(0.0))

    own = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("t"), share("block").alias("b")).where("t + b > 0")
    own = written(own, "listed")
    seeds = own.select("host", F.explode(F.map_from_arrays(F.array(F.lit("t"), F.lit("b")), F.array("t", "b"))).alias("kind", "weight")).where("weight > 0")
    got = spread(host_edges(pages, url_col, html_col), seeds, rounds)
    neutral = F.coalesce(1 - F.col("t") - F.col("b"), F.lit(0.0)) * (1 - DAMPING)
    part = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust") + neutral), 4)
    got = got.join(own, "host", "left").select("host", part.alias("distrust")).where("distrust > 0")
    out = rows.join(written(got, "hosts"), "host", "left")
    method = F.when(F.col("distrust") > threshold, "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "distrust")
