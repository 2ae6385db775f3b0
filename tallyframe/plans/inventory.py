"""INV plans: ``documents`` stand in for a file listing.

Stand-in mapping: root = source, path = source/lang/doc_id.txt,
length = n_chars, mtime = 2024-01-01 + doc_id hours,
class by lang (en backup, fr log, de archive, es model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import inventory as I
from tallyframe.plans.common import pin_utc, t

NOW = "2024-02-15 00:00:00"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    d = t(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("source").alias("root"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.col("n_chars").alias("length"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("doc_id").cast("int"))).alias("mtime"),
        F.when(F.col("lang") == "en", "backup").when(F.col("lang") == "fr", "log")
         .when(F.col("lang") == "de", "archive").otherwise("model").alias("class"))


def older(spark, sf_dir):
    f = I.exclude_prefix(listing(spark, sf_dir), "path", "src0/")
    now = F.lit(NOW).cast("timestamp")
    return f.select("path", I.older_than(F.col("mtime"), now, 30).alias("older_strict"),
                    I.older_than(F.col("mtime"), now, 30, "whole_days").alias("older_whole_days"))


def flagged(spark, sf_dir):
    f = listing(spark, sf_dir)
    lab = t(spark, sf_dir, "labels")
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    cand = lab.join(docs, "doc_id", "left").select(
        F.when(F.col("quality") == 0, F.concat(F.lit("missing/"), F.col("doc_id").cast("string")))
         .otherwise(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
         .alias("path"),
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("delete"))
    return I.flagged_for_delete(cand, f)


def newest(spark, sf_dir):
    f = listing(spark, sf_dir)
    return I.keep_newest(f, ["root"], 3, "mtime", "path").select("root", "path", "length")


def tails(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    tl = I.tail_lines(F.col("text"), 3)
    return d.select("doc_id", F.size(tl).alias("n_lines"), F.md5(F.array_join(tl, "\n")).alias("md5"))


def tail_events(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "event_type")
    return I.tail_rows(e, "event_id", 50)


def required(spark, sf_dir):
    pin_utc(spark)
    d = t(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"),
                              F.when(F.col("lang") == "en", F.lit(".txt"))
                              .otherwise(F.concat(F.lit("-"), F.col("lang"), F.lit(".txt")))).alias("name"),
                     (F.lit("2024-01-01 00:00:00").cast("timestamp") +
                      F.make_interval(hours=F.col("doc_id").cast("int"))).alias("mtime"))
    req = t(spark, sf_dir, "labels").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    # two generations of backups; some are only named like the file without its extension
    gen = d.withColumn("gen", F.explode(F.array(F.lit(1), F.lit(2))))
    old = gen.where(F.col("doc_id") % 3 < 2).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit(".txt.")).otherwise(F.lit("-")),
                 F.col("gen").cast("string")).alias("name"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=(F.col("gen") * (F.col("doc_id") % 2 * 2 - 1)).cast("int"))).alias("mtime"))
    return I.missing_required(req, files, old).select("name", "candidate", "abort")


def checksums(spark, sf_dir):
    d = listing(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    a = d.select("path", F.sha2("text", 256).alias("sha256"))
    b = d.select("path", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" ")))
                                .otherwise(F.col("text")), 256).alias("sha256"))
    return I.verify_checksums(a, b).select("path", "match")


def combined(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    li = t(spark, sf_dir, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.max("l_discount") > 0.09, F.lit(2)).otherwise(F.lit(0)).alias("status"))
    b = o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(3)).otherwise(F.lit(0)).alias("status"))
    return I.combine_reports(o, a, b, "o_orderkey")


def by_size(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("bigint").alias("length"))
    v = listing(spark, sf_dir).select(F.col("path").alias("variant"), "length")
    return I.match_by_size(p, v).select("page_id", "length", "exists", "matched_variant", "n_matches")


def space(spark, sf_dir):
    f = I.mark_reclaimable(listing(spark, sf_dir), F.lit(NOW).cast("timestamp"), keep_backups=3, log_days=7,
                           archive_dir="src1/")
    return I.space_report(f)


def digests(spark, sf_dir):
    f = listing(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return I.file_digest(f, "text").select("path", "length", "mtime", "sha256")


def report_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", I.last_json_line(F.col("text")).isNotNull().alias("last_is_json"),
                    F.size(I.lines_with(F.col("text"), "License")).alias("n_license_lines"))


def recommendations(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    rec = I.recommend(F.col("lang") != "es", F.col("n_chars") * 100000, F.col("lang") == "en",
                      F.when(F.col("doc_id") % 5 != 0, F.lit(100.0)), F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") / 10.0),
                      F.when(F.col("lang") == "fr", F.lit(1)).when(F.col("lang") == "de", F.lit(0)),
                      F.when(F.col("source") == "src1", F.array(F.lit("IMPORT_ERROR x")))
                      .otherwise(F.array().cast("array<string>")))
    return d.select("doc_id", F.array_join(rec, "|").alias("recommendations"))


def process_lines(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    ps = e.select("event_id", F.concat_ws(" ", F.col("user_id").cast("string"),
                                          F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/usr/bin/"), "event_type"))
                                          .otherwise(F.col("event_type")),
                                          (F.col("value") * 1024).cast("bigint").cast("string")).alias("line"))
    return I.parse_process_lines(ps, "line", "click").select("event_id", "pid", F.round("rss_mb", 6).alias("rss_mb"))


def process_csv(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    csv = e.select("event_id", F.concat(
        F.lit('"'), F.upper("event_type"), F.lit('.exe","'), F.col("user_id").cast("string"),
        F.lit('","Console","1","'), F.format_number((F.col("value") * 100).cast("bigint"), 0), F.lit(' K"')).alias("line"))
    return I.parse_process_lines(csv, "line", "View", form="csv").select(
        "event_id", "pid", F.round("rss_mb", 6).alias("rss_mb"))


_SQL_LISTING = """files AS (
  SELECT doc_id, source AS root, source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS length,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS mtime,
         CASE lang WHEN 'en' THEN 'backup' WHEN 'fr' THEN 'log' WHEN 'de' THEN 'archive' ELSE 'model' END AS class,
         text
  FROM documents)"""

SQL_OLDER = f"""WITH {_SQL_LISTING}
SELECT path, mtime < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS older_strict,
       floor(epoch(TIMESTAMP '{NOW}') - epoch(mtime)) // 86400 >= 30 AS older_whole_days
FROM files WHERE NOT starts_with(path, 'src0/')"""

SQL_FLAGGED = f"""WITH {_SQL_LISTING},
cand AS (
  SELECT CASE WHEN l.quality = 0 THEN 'missing/' || l.doc_id
              ELSE d.source || '/' || d.lang || '/' || l.doc_id || '.txt' END AS path,
         (l.toxic = 1 OR l.quality = 0) AS del
  FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)
SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes
FROM files WHERE path IN (SELECT path FROM cand WHERE coalesce(del, false))"""

SQL_NEWEST = f"""WITH {_SQL_LISTING},
r AS (SELECT root, path, length, row_number() OVER (PARTITION BY root ORDER BY mtime DESC, path) AS rn FROM files)
SELECT root, path, length FROM r WHERE rn > 3"""

SQL_TAILS = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, list_slice(ls, greatest(1, len(ls) - 3 + 1), len(ls)) AS tl FROM l)
SELECT doc_id, CAST(len(tl) AS INTEGER) AS n_lines, md5(array_to_string(tl, chr(10))) AS md5 FROM s"""

SQL_TAIL_EVENTS = "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50"

SQL_REQUIRED = """
WITH files AS (SELECT 'doc-' || doc_id || CASE WHEN lang = 'en' THEN '.txt' ELSE '-' || lang || '.txt' END AS name FROM documents),
old AS (
  SELECT 'doc-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt.' ELSE '-' END || gen AS name, gen * (doc_id % 2 * 2 - 1) AS mtime
  FROM documents, (VALUES (1), (2)) g(gen) WHERE doc_id % 3 < 2),
req AS (SELECT DISTINCT 'doc-' || doc_id || '.txt' AS name FROM labels),
miss AS (SELECT name FROM req WHERE name NOT IN (SELECT name FROM files)),
cand AS (SELECT m.name, arg_max(f.name, (f.mtime, f.name)) AS candidate FROM miss m JOIN old f ON starts_with(f.name, m.name) GROUP BY m.name)
SELECT miss.name, cand.candidate, cand.candidate IS NULL AS abort FROM miss LEFT JOIN cand ON miss.name = cand.name"""

SQL_CHECKSUMS = f"""WITH {_SQL_LISTING}
SELECT path, sha256(text) = sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' ' ELSE text END) AS match FROM files"""

SQL_COMBINED = """
WITH a AS (SELECT l_orderkey AS k, CASE WHEN max(l_discount) > 0.09 THEN 2 ELSE 0 END AS s FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END AS s FROM orders
      WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT o.o_orderkey, a.s AS a_status, b.s AS b_status, coalesce(nullif(a.s, 0), nullif(b.s, 0), 0) AS status
FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN a ON o.o_orderkey = a.k LEFT JOIN b ON o.o_orderkey = b.k"""

SQL_BY_SIZE = f"""WITH {_SQL_LISTING},
v AS (SELECT length, min(path) AS matched_variant, CAST(count(*) AS BIGINT) AS n_matches FROM files GROUP BY length)
SELECT p.page_id, CAST(length(p.html) AS BIGINT) AS length, v.matched_variant IS NOT NULL AS exists,
       v.matched_variant, coalesce(v.n_matches, 0) AS n_matches
FROM pages p LEFT JOIN v ON CAST(length(p.html) AS BIGINT) = v.length"""

SQL_SPACE = f"""WITH {_SQL_LISTING},
rb AS (SELECT path, row_number() OVER (PARTITION BY root ORDER BY mtime DESC, path) AS rn FROM files WHERE class = 'backup'),
f AS (
  SELECT f.*, (class = 'archive' OR coalesce(rb.rn > 3, false)
               OR (class = 'log' AND NOT starts_with(f.path, 'src1/') AND mtime < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)) AS reclaimable
  FROM files f LEFT JOIN rb ON f.path = rb.path)
SELECT root, class, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(length) AS BIGINT) AS bytes,
       CAST(sum(CASE WHEN reclaimable THEN length ELSE 0 END) AS BIGINT) AS reclaimable_bytes
FROM f GROUP BY ROLLUP (root, class)"""

SQL_DIGESTS = f"""WITH {_SQL_LISTING} SELECT path, length, mtime, sha256(text) AS sha256 FROM files"""

SQL_REPORT_LINES = """
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents)
SELECT doc_id, coalesce(json_valid(ls[-1]), false) AS last_is_json,
       CAST(len(list_filter(ls, lambda x: contains(x, 'License'))) AS INTEGER) AS n_license_lines FROM l"""

SQL_RECOMMEND = """
WITH r AS (
  SELECT doc_id, lang <> 'es' AS fe, n_chars * 100000 AS sz, lang = 'en' AS qa, CASE WHEN doc_id % 5 <> 0 THEN 100.0 END AS rb,
         CASE WHEN doc_id % 7 <> 0 THEN n_chars / 10.0 END AS ra,
         CASE WHEN lang = 'fr' THEN 1 WHEN lang = 'de' THEN 0 END AS ec, source = 'src1' AS imp
  FROM documents),
s AS (SELECT *, (NOT fe OR sz < 200000000) AS stub, rb IS NOT NULL AND ra IS NOT NULL AND ((ra - rb >= 500) OR (ra >= 500)) AS loaded FROM r)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN stub THEN 'Replace models/gpt-oss-20b.gguf with a real gguf (size several GB).' END,
  CASE WHEN NOT qa THEN 'Install/build quantize tool (link: README/Runbook) or use remote inference.' END,
  CASE WHEN loaded THEN 'Model appears loaded; re-run full obedience pack and bench under real model.'
       WHEN fe AND NOT stub THEN 'Model file present but load did not increase RSS; check llama-cpp-python compatibility or use alternative loader.' END,
  CASE WHEN ec IS NOT NULL AND ec <> 0 AND NOT imp THEN 'Model load could not be validated; check reports/check_model_load.txt for loader errors.'
       WHEN imp THEN 'Model load could not be validated due to missing imports; ensure psutil and llama-cpp-python are installed.' END
  ], lambda x: x IS NOT NULL), '|') AS recommendations
FROM s"""

SQL_PROCESS = """
SELECT event_id, CAST(user_id AS INTEGER) AS pid, round(CAST(CAST(trunc(value * 1024) AS BIGINT) AS DOUBLE) / 1024.0, 6) AS rss_mb
FROM events WHERE event_type = 'click'"""

SQL_PROCESS_CSV = """
SELECT event_id, CAST(user_id AS INTEGER) AS pid, round(CAST(CAST(trunc(value * 100) AS BIGINT) AS DOUBLE) / 1024.0, 6) AS rss_mb
FROM events WHERE event_type = 'view'"""

QUERIES = {
    "inv_older_than": (older, SQL_OLDER),
    "inv_flagged_for_delete": (flagged, SQL_FLAGGED),
    "inv_keep_newest": (newest, SQL_NEWEST),
    "inv_tail_lines": (tails, SQL_TAILS),
    "inv_tail_rows": (tail_events, SQL_TAIL_EVENTS),
    "inv_missing_required": (required, SQL_REQUIRED),
    "inv_verify_checksums": (checksums, SQL_CHECKSUMS),
    "inv_combine_reports": (combined, SQL_COMBINED),
    "inv_match_by_size": (by_size, SQL_BY_SIZE),
    "inv_space_report": (space, SQL_SPACE),
    "inv_file_digest": (digests, SQL_DIGESTS),
    "inv_report_lines": (report_lines, SQL_REPORT_LINES),
    "inv_recommend": (recommendations, SQL_RECOMMEND),
    "inv_process_lines": (process_lines, SQL_PROCESS),
    "inv_process_csv": (process_csv, SQL_PROCESS_CSV),
}
