"""Registered queries of the corpus operators: name -> (callable, oracle SQL).

Each query applies its operator with production parameters to the whole
intended table. Where SQL cannot state the result the oracle is ``None`` and
``tests/llm`` holds the query against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (decontaminate, html_density, infill, mixture, ngram_join, packing, pii, quality, toxicity, url_graph,
                            warc, whitening, word_pieces)
from tallyframe.llm.common import written
from tallyframe.sources.tables import read_table


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust
    outlier rule per language and source."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = written(quality.base_statistics(d).drop("text"), "op7")
    return quality.judge(stats, ["lang", "source"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity class and number of links of every document: five-word
    shingles, Jaccard similarity 0.8 or more."""
    return ngram_join.similarity_classes(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies", "n_text_links")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a benchmark window, and the
    items they come from."""
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, bench).drop("text_hash").withColumnRenamed("id", "doc_id")


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL_DECONTAMINATION = f"""
with d as materialized (select row_number() over () as rid, doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
bw as materialized (
  select distinct item_id, k, array_to_string(w[p + 1 : p + k], ' ') as win
  from (select item_id, w, least(10, len(w)) as k, unnest(range(0, len(w) - least(10, len(w)) + 1)) as p from b where len(w) > 0)),
dw as (
  select rid, p, k, array_to_string(w[p + 1 : p + k], ' ') as win
  from (select rid, w, k, unnest(range(0, len(w) - k + 1)) as p from d, (select distinct k from bw) where len(w) >= k)),
hits as materialized (select distinct rid, p, k, win from dw semi join bw using (k, win)),
covered as (select rid, count(distinct p + o) as n_hit from (select rid, p, unnest(range(k)) as o from hits) group by rid),
named as (select rid, list_sort(list(distinct cast(item_id as varchar)) filter (where item_id is not null)) as ids from hits join bw using (k, win) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join named using (rid)
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: fixed patterns, and those that
    the skip-chain field adds."""
    return pii.find_spans(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every source and words taken of every document."""
    return mixture.mixture(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL_MIXTURE = r"""
with d as materialized (
  select * exclude (text), cast('0x' || substr(md5(concat('mix-1:', coalesce(cast(doc_id as varchar), ''), ':', md5(text))), 1, 15) as bigint) as draw
  from (select doc_id, source, coalesce(text, '') as text, cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as size from documents)),
s as (select source, sum(size) as total, row_number() over (order by source nulls last) as rank from d group by source),
w as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight, 2 * total as cap from s),
l as (
  select *, (1.5::double * sum(total) over ()
    - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from w),
t as (select source, total, least(cap::double, max(level) over () * weight) as target from l),
p as (select source, total, target, case when total > 0 then floor(target / total) else 0 end as whole from t),
o as (
  select *, sum(size) over (partition by source order by draw, copy rows unbounded preceding) - size / 2 as middle
  from (select *, row_number() over (partition by source, draw) as copy from d))
select doc_id, size, cast(total as bigint) as source_size, target,
  cast(size * (whole + case when middle < target - whole * total then 1 else 0 end) as bigint) as taken
from o join p on o.source is not distinct from p.source
"""


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    return warc.archived(read_table(spark, sf_dir, "pages"))


SQL_WARC = """
with p as (select page_id, sha1(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') as url from pages),
g as (select *, max(page_id) over (partition by digest) as holder from p),
r as (select *, case when n >= 1000 and holder is not null and page_id is distinct from holder then holder end as refers_to from g)
select page_id, n as payload_bytes, digest as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
  case when refers_to is null
    then n + 244 + coalesce(length(cast(page_id as varchar)), 0) + coalesce(octet_length(encode(url)), -19) + length(cast(n as varchar))
    else 357 + coalesce(length(cast(page_id as varchar)), 0) + coalesce(octet_length(encode(url)), -19) + length(cast(refers_to as varchar)) end as record_bytes,
  true as verified
from r
"""


def op3_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: listed rules, else trust and distrust
    spread over the links between hosts until every host has settled."""
    return url_graph.judge(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _sql_url_graph() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    href = url_graph._HREF.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_graph.RULES)
    d = url_graph.DAMPING
    return f"""
with recursive p as materialized (
  select row_number() over () as rid, page_id, html, {low("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(verdict, rh, rp) as (values {rules}),
m as materialized (
  select rid, max_by(rh || rp, length(rh || rp)) as rule, max_by(verdict, length(rh || rp)) as listed
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by rid),
e as materialized (
  select distinct src, dst from (
    select host as src, {low("unnest(regexp_extract_all(coalesce(html, ''), '" + href + "', 1))")} as dst from p) where src <> '' and src <> dst),
own as materialized (
  select host, avg(case when listed = 'allow' then 1.0::double else 0 end) as t, avg(case when listed = 'block' then 1.0::double else 0 end) as b
  from p left join m using (rid) where host <> '' group by host),
f as materialized (
  select 't' as kind, src as host, dst, 1.0::double / count(*) over (partition by src) as w from e
  union all select 'b', dst, src, 1.0::double / count(*) over (partition by dst) from e),
s(kind, host, v, step) as (
  select kind, host, {1 - d!r} * weight, 0 from (select 't' as kind, host, t as weight from own union all select 'b', host, b from own) where weight > 0
  union all
  select f.kind, f.dst, sum({d} * s.v * f.w), max(step) + 1 from s join f on f.kind = s.kind and f.host = s.host where step < 250 group by f.kind, f.dst),
sh as (
  select host, round(distrust / (distrust + trust + coalesce(1 - t - b, 0) * case when coalesce(t + b, 0) > 0 then {1 - d!r} else 0 end), 4) as distrust
  from (select host, sum(case when kind = 'b' then v else 0 end) as distrust, sum(case when kind = 't' then v else 0 end) as trust from s group by host) left join own using (host))
select page_id, p.host, path, rule, coalesce(listed, case when distrust > {url_graph.THRESHOLD} then 'block' else 'allow' end) as verdict,
  case when distrust > 0 then distrust end as distrust
from p left join m using (rid) left join sh on sh.host = p.host
"""


def op1_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by composite text density."""
    return html_density.extract(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labelled documents
    outside the held-out fold. The subword bag and the softmax work on single
    words; a document's score is the noisy-or over its words, so one insult in
    a long text counts."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


#: Word-piece vocabulary of the token count query; a path that the driver reads.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op9_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece token count of every document, all characters counted."""
    return word_pieces.count_pieces(read_table(spark, sf_dir, "documents"), VOCABULARY, spelled=True).withColumnRenamed("id", "doc_id")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, one row per vector and component."""
    w = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    cells = w.select(F.col("id").alias("vec_id"), "n", "deviation", "deviation_digits", "identity_error",
                     F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return cells.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
                        F.col("c.explained").alias("explained"), "identity_error", "deviation_digits")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    import public_tokenizers

    pieces = packing.tokenized(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    pieces = written(pieces.withColumn("ids_crc32", F.crc32("ids")), "pack-pieces")  # the ids stay in the table
    return packing.pack(pieces.drop("ids")).withColumnRenamed("id", "doc_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and its text rebuilt."""
    f = infill.infill(read_table(spark, sf_dir, "documents"))
    return f.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"))


SQL_INFILL = """
with d as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (
  select *, string_split(text, chr(10)) as parts, len(string_split(text, chr(10))) - case when text = '' or right(text, 1) = chr(10) then 1 else 0 end as n,
    [cast('0x' || substr(h, 1 + 8 * i, 8) as bigint) for i in [0, 1, 2, 3]] as r from d),
c as (
  select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain'
      when r[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
e as (
  select *, case when a = n then text when a = 0 then '' else array_to_string(parts[1:a], chr(10)) || chr(10) end as p,
    case when b = n then text when b = 0 then '' else array_to_string(parts[1:b], chr(10)) || chr(10) end as pm from c),
f as (select *, substr(pm, length(p) + 1) as m, substr(text, length(pm) + 1) as s from e)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then text else p || m || s end) as restored_sha256
from f
"""


QUERIES = {
    "op1_html_text_density": (op1_html_text_density, None),
    "op2_warc_archive": (op2_warc_archive, SQL_WARC),
    "op3_url_link_graph": (op3_url_link_graph, _sql_url_graph()),
    "op4_benchmark_decontamination": (op4_benchmark_decontamination, SQL_DECONTAMINATION),
    "op5_personal_data": (op5_personal_data, None),
    "op6_toxicity_subwords": (op6_toxicity_subwords, None),
    "op7_quality_outliers": (op7_quality_outliers, None),
    "op8_ngram_jaccard_join": (op8_ngram_jaccard_join, None),
    "op9_word_piece_counts": (op9_word_piece_counts, None),
    "op10_source_mixture": (op10_source_mixture, SQL_MIXTURE),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_best_fit_packing": (op12_best_fit_packing, None),
    "op13_fill_in_middle": (op13_fill_in_middle, SQL_INFILL),
}
