"""Content-addressed WARC archive.

A record's payload bytes are stored once under their SHA-256 digest; the exact
header block of every record is stored separately with the digest of its
payload. Reading joins the two tables by digest, checks the stored bytes
against both digests, and yields each record as it was written. Records with
equal payloads of ``MIN_REVISIT`` bytes or more are revisits of the one with
the largest page id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

MIN_REVISIT = 1000
VERSION = "WARC/1.1"
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
#: One capture time for all records: the pages carry none.
DATE = "1970-01-01T00:00:00Z"
#: Name of a record without an id. In a string id a per cent sign is escaped; an empty one is a bare per cent sign.
NO_ID = "<urn:page:>"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables lie."""

    root: str

    @property
    def payloads(self) -> str:
        return f"{self.root}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.root}/headers"


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line breaks in a value are escaped."""
    v = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), v, F.lit("\r\n")), F.lit(""))


def header_block(page_id: Column, url: Column, size: Column, sha1: Column, refers_to: Column) -> Column:
    """The header of one record up to and with its empty line."""
    def urn(c: Column) -> Column:
        text = F.replace(c.cast("string"), F.lit("%"), F.lit("%25"))
        return F.concat(F.lit("<urn:page:"), F.when(text == "", "%").otherwise(text), F.lit(">"))

    revisit = refers_to.isNotNull()
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(urn(page_id), F.lit(NO_ID))), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Refers-To", urn(refers_to)), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")), F.lit("\r\n"))


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Write one record per row of ``pages`` into a new archive at ``root``.

    A null page is an empty payload, a null url gives no target line, a null
    id an empty record name; extra columns are not read. Rows that repeat the
    largest id of a payload are all responses; a payload without any id has no
    revisits. An empty table gives an empty archive.
    """
    a = Archive(root)
    spark = pages.sparkSession
    p = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                     F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    p.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")).write.parquet(f"{root}/index")
    index = spark.read.parquet(f"{root}/index")

    # only digests that occur again need a holder: one narrow row each
    index.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("holder")).where("n > 1").drop("n").write.parquet(f"{root}/shared")
    shared = spark.read.parquet(f"{root}/shared")
    refers_to = F.when((F.col("size") >= MIN_REVISIT) & ~F.col("id").eqNullSafe(F.col("holder")), F.col("holder"))
    rows = index.join(shared, "digest", "left").withColumn("refers_to", refers_to)
    rows.select("digest", header_block(F.col("id"), F.col("url"), F.col("size"), F.col("sha1"), F.col("refers_to")).alias("header")).write.parquet(a.headers)

    single = p.join(shared, "digest", "left_anti").select("digest", "payload")
    h = shared.select(F.col("digest").alias("h_digest"), "holder")
    several = p.join(h, (F.col("digest") == F.col("h_digest")) & F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    single.unionByName(several.select("digest", "payload").dropDuplicates(["digest"])).write.parquet(a.payloads)
    return a


def field(header: Column, name: str) -> Column:
    """Value of a header line, null where the record has none."""
    v = F.regexp_extract(header, f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(v != "", v)


def read_archive(spark: SparkSession, a: Archive) -> DataFrame:
    """Every record: ``header``, ``record`` (its exact bytes: header block,
    payload block of a response, two line ends), ``payload`` (the full one,
    also of a revisit) and ``verified`` (the stored bytes have the digest they
    are stored under and the one the header names). A header whose payload is
    missing comes back with nulls and ``verified`` false."""
    store = spark.read.parquet(a.payloads).withColumnRenamed("digest", "p_digest")
    r = spark.read.parquet(a.headers).join(store, F.col("digest") == F.col("p_digest"), "left")
    own = F.concat(F.lit("sha1:"), F.sha1("payload"))
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    verified = F.coalesce((F.sha2("payload", 256) == F.col("digest")) & (field(F.col("header"), "WARC-Payload-Digest") == own), F.lit(False))
    record = F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return r.select("header", record.alias("record"), "payload", verified.alias("verified"))


def page_of(value: Column, kind: str = "bigint") -> Column:
    """The page id in a record name, in the ids' own type; null where the
    record has none."""
    inner = F.substring(value, F.lit(11), F.greatest(F.lit(0), F.length(value) - 11))
    for mark, text in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        inner = F.replace(inner, F.lit(mark), F.lit(text))
    inner = F.when(F.endswith(value, F.lit(":%>")), F.lit("")).otherwise(inner)
    return F.when(value != NO_ID, inner if kind == "string" else inner.try_cast(kind))


def archived(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive (by default in the shared checkpoint
    folder) and read it back: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``record_bytes`` and
    ``verified``, all taken from the records read."""
    spark = pages.sparkSession
    r = read_archive(spark, write_archive(pages, root or scratch_path(spark, "warc")))
    h, kind = F.col("header"), pages.schema["page_id"].dataType.simpleString()
    return r.select(
        page_of(field(h, "WARC-Record-ID"), kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), field(h, "WARC-Type").alias("record_type"),
        page_of(field(h, "WARC-Refers-To"), kind).alias("refers_to"), F.octet_length("record").cast("long").alias("record_bytes"), "verified")
