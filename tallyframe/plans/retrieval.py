"""RET plans: corpus -> hash embedding -> exact k-NN, metadata, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.embed import hash_embed, hash_words
from tallyframe.operators import retrieval as R
from tallyframe.plans.common import t


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over every document: word sum and the 16 float32 components."""
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    e = d.select("doc_id",
                 F.aggregate(hash_words(F.col("text")), F.lit(0).cast("bigint"),
                             lambda a, x: a + x).alias("word_sum"),
                 hash_embed(F.col("text")).alias("emb"))
    return e.select("doc_id", "word_sum",
                    *[F.round(F.col("emb")[i].cast("double"), 6).alias(f"e{i:02d}") for i in range(16)])


def knn_documents(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """J1 + P1 + T1: every benchmark text against every document, top-3 by
    squared L2 over hash embeddings, ties by doc_id."""
    docs = t(spark, sf_dir, "documents").select(
        F.col("doc_id"), hash_embed(F.col("text")).alias("embedding"))
    qs = t(spark, sf_dir, "benchmark").select(
        F.col("item_id"), hash_embed(F.col("text")).alias("embedding"))
    r = R.knn(qs, docs, k, query_key="item_id", corpus_key="doc_id")
    return r.select("item_id", "rank", "doc_id", F.round("dist", 6).alias("dist"))


def knn_embeddings(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """J1 on the real 64-d vectors: every vector as a query against the whole
    table (itself included at distance 0)."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    r = R.knn(e.withColumnRenamed("vec_id", "query_id"), e, k,
              query_key="query_id", corpus_key="vec_id")
    return r.select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"))


def search_documents(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """each whole line of a benchmark text as a case-insensitive
    substring query over every document; first k hits by doc_id."""
    qs = t(spark, sf_dir, "benchmark").select(F.col("item_id"), F.posexplode(F.split("text", "\n")).alias("line", "query"))
    qs = qs.select(F.concat_ws(":", "item_id", "line").alias("qid"), "query").where("query <> ''")
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return R.substring_search(docs, qs, k).select(
        F.col("qid").alias("line_id"), "rank", F.col("pos").alias("doc_id"), "score")


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach label payloads to every embedding by position; unlabeled
    rows get ``{}``; id from the payload when it carries one."""
    vec = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"))
    lab = t(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"),
        F.to_json(F.struct(
            F.when(F.col("toxic") == 1, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"),
            F.col("quality"))).alias("payload"))
    return R.attach_metadata(vec, lab).select("pos", "id", "payload")


def _sql_hash_embed(src: str, key: str, text: str, name: str) -> str:
    """DuckDB CTE text: ``name(id, i, x FLOAT)`` long-form hash embedding."""
    return f"""
{name}_w AS (
  SELECT {key} AS id, r.i AS i,
         (('0x' || substr(sha256({text}), 4 * r.i + 1, 4))::INTEGER % 1000) AS w
  FROM {src}, range(16) r(i)),
{name} AS (
  SELECT id, i,
         CAST(w::DOUBLE / CASE WHEN sum(w) OVER (PARTITION BY id) = 0 THEN 1
                               ELSE sum(w) OVER (PARTITION BY id) END AS FLOAT) AS x,
         sum(w) OVER (PARTITION BY id) AS word_sum
  FROM {name}_w)"""


SQL_EMBED_DOCUMENTS = "WITH " + _sql_hash_embed("documents", "doc_id", "text", "e") + """
SELECT id AS doc_id, CAST(any_value(word_sum) AS BIGINT) AS word_sum,
""" + ",\n".join(
    f"  round(CAST(max(CASE WHEN i = {i} THEN x END) AS DOUBLE), 6) AS e{i:02d}" for i in range(16)) + """
FROM e GROUP BY id"""

SQL_KNN_DOCUMENTS = "WITH " + _sql_hash_embed("documents", "doc_id", "text", "d") + "," + \
    _sql_hash_embed("benchmark", "item_id", "text", "q") + """,
dq AS (SELECT id, list(x::DOUBLE ORDER BY i) AS v FROM d GROUP BY id),
qq AS (SELECT id, list(x::DOUBLE ORDER BY i) AS v FROM q GROUP BY id),
pairs AS (
  SELECT qq.id AS item_id, dq.id AS doc_id,
         list_reduce(list_transform(list_zip(qq.v, dq.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
                     lambda a, b: a + b) AS dist
  FROM qq CROSS JOIN dq),
ranked AS (
  SELECT item_id, doc_id, dist,
         row_number() OVER (PARTITION BY item_id ORDER BY dist, doc_id) AS rank
  FROM pairs)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(dist, 6) AS dist
FROM ranked WHERE rank <= 3"""

SQL_KNN_EMBEDDINGS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_reduce(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
                     lambda x, y: x + y) AS dist
  FROM v a CROSS JOIN v b),
ranked AS (
  SELECT query_id, vec_id, dist,
         row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
  FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist
FROM ranked WHERE rank <= 5"""

SQL_SEARCH_DOCUMENTS = """
WITH q AS (
  SELECT item_id || ':' || CAST(i - 1 AS VARCHAR) AS line_id, lower(ls[i]) AS q
  FROM (SELECT item_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM benchmark) WHERE ls[i] <> ''),
hits AS (SELECT q.line_id, d.doc_id FROM q JOIN documents d ON contains(lower(d.text), q.q)),
ranked AS (SELECT line_id, doc_id, row_number() OVER (PARTITION BY line_id ORDER BY doc_id) AS rank FROM hits)
SELECT line_id, CAST(rank AS INTEGER) AS rank, doc_id, 0.9::DOUBLE AS score FROM ranked WHERE rank <= 5"""

SQL_SNAPSHOT_RECORDS = """
SELECT e.vec_id AS pos,
       CASE WHEN l.toxic = 1 THEN 'doc-' || l.doc_id ELSE CAST(e.vec_id AS VARCHAR) END AS id,
       CASE WHEN l.doc_id IS NULL THEN '{}'
            WHEN l.toxic = 1 THEN '{"id":"doc-' || l.doc_id || '","quality":' || l.quality || '}'
            ELSE '{"quality":' || l.quality || '}' END AS payload
FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id"""

QUERIES = {
    "ret_embed_documents": (embed_documents, SQL_EMBED_DOCUMENTS),
    "ret_knn_documents": (knn_documents, SQL_KNN_DOCUMENTS),
    "ret_knn_embeddings": (knn_embeddings, SQL_KNN_EMBEDDINGS),
    "ret_search_documents": (search_documents, SQL_SEARCH_DOCUMENTS),
    "ret_snapshot_records": (snapshot_records, SQL_SNAPSHOT_RECORDS),
}
