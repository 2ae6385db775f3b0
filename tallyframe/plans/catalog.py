"""CAT plans: ``lineitem`` joined to ``part`` stands in for tensor catalogs.

Stand-in mapping (rows only; every operator recomputes from them):
model = l_orderkey, pos = l_linenumber, role from p_type, suffix from
p_size / l_returnflag, d1 = int(l_quantity) * 32, d2 = p_size * 32,
shape [d2] for norms and biases, [4, d1, d2] for expert tensors, else
[d1, d2]; dtype F32 for 1-D, else F16 / BF16 by l_discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators import catalog as C
from tallyframe.plans.common import spread, t
from tallyframe.session import materialize

# Role names of the stand-in and their checkpoint-side names.
ROLE_BY_TYPE = {"STANDARD": "attn_q", "MEDIUM": "attn_k", "ECONOMY": "ffn_up_exps",
                "LARGE": "ffn_down", "SMALL": "attn_norm", "PROMO": "token_embd"}
SOURCE_ROLE = {"attn_q": "self_attn.q_proj", "attn_k": "self_attn.k_proj",
               "ffn_up_exps": "mlp.experts.up_proj", "ffn_down": "mlp.down_proj",
               "attn_norm": "input_layernorm"}
# Name mapping patterns (checkpoint name -> catalog name).
NAME_PATTERNS = [
    ("model.embed_tokens", "token_embd", 0),
    ("model.layers.{bid}.self_attn.q_proj", "blk.{bid}.attn_q", 0),
    ("model.layers.{bid}.self_attn.k_proj", "blk.{bid}.attn_k", 0),
    ("model.layers.{bid}.mlp.down_proj", "blk.{bid}.ffn_down", 0),
    ("model.layers.{bid}.input_layernorm", "blk.{bid}.attn_norm", 0),
    ("model.layers.{bid}.mlp.experts.up_proj", "blk.{bid}.ffn_up_exps", 0),
]
SHARD_MAX_TENSORS = 3
SHARD_MAX_BYTES = 2_000_000


def _role():
    r = F.lit(None).cast("string")
    for k, v in reversed(list(ROLE_BY_TYPE.items())):
        r = F.when(F.col("p_type") == k, F.lit(v)).otherwise(r)
    return r


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_quantity", "l_returnflag", "l_discount")
    p = t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    role = _role()
    sfx = (F.when(F.col("p_size") % 9 == 0, F.lit(".rotary_emb.inv_freq"))
           .when(F.col("l_returnflag") == "R", F.lit(".bias")).otherwise(F.lit(".weight")))
    name = F.when(role == "token_embd", F.concat(role, sfx)).otherwise(
        F.concat(F.lit("blk."), (F.col("l_linenumber") - 1).cast("string"), F.lit("."), role, sfx))
    d1 = F.col("l_quantity").cast("int").cast("bigint") * 32
    d2 = F.col("p_size").cast("bigint") * 32
    shape = (F.when((role == "attn_norm") | (sfx == ".bias"), F.array(d2))
             .when(role == "ffn_up_exps", F.array(F.lit(4).cast("bigint"), d1, d2))
             .otherwise(F.array(d1, d2)))
    # tensor position: insertion order within the model (lines of one order)
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    j = j.withColumn("l_linenumber", pos)
    c = j.select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("pos"),
                 role.alias("role"), name.alias("name"), shape.alias("shape"), "l_discount", "p_size")
    return c.withColumn("dtype", F.when(F.size("shape") <= 1, F.lit("F32"))
                        .when(F.col("l_discount") < 0.05, F.lit("F16")).otherwise(F.lit("BF16")))


def sizes(spark, sf_dir):
    c = C.skip_suffixes(catalog(spark, sf_dir))
    nb = C.n_bytes(F.col("shape"), F.col("dtype"))
    g = C.group_key(F.col("name"))
    return c.select("model", "pos", "name", C.n_elements(F.col("shape")).alias("n_elements"),
                    nb.alias("n_bytes"), C.pad_to(nb).alias("padded"), C.human_bytes(nb).alias("human"),
                    C.block_id(F.col("name")).alias("block_id"), g.alias("group"),
                    C.expand_abbrev(g).alias("heading"),
                    F.array_join(C.disk_dims(F.col("shape")).cast("array<string>"), "x").alias("disk_dims"))


def storage(spark, sf_dir):
    c = catalog(spark, sf_dir)
    req = F.when(F.col("model") % 2 == 0, F.lit("Q8_0")).otherwise(F.lit("TQ1_0"))
    st = C.storage_type(F.col("name"), F.size("shape"), req, last_dim=F.element_at("shape", -1))
    return c.select("model", "pos", "name", req.alias("requested"), st.alias("storage"))


def _with_lora(c):
    """Some tensors as a low-rank pair with a plain tensor between its halves;
    a few second halves stand alone."""
    def row(step, suffix):
        return F.struct((F.col("pos") * 4 + step).alias("pos"), F.concat("name", F.lit(suffix)).alias("name"))

    rows = (F.when(F.col("p_size") % 5 == 1, F.array(row(0, ".lora_a"), row(1, ".mid"), row(2, ".lora_b")))
            .when(F.col("p_size") % 25 == 2, F.array(row(0, ".lora_b"))).otherwise(F.array(row(0, ""))))
    return c.select("model", "shape", F.explode(rows).alias("r")).select("model", "shape", "r.*")


def param_count(spark, sf_dir):
    r = C.parameter_count(_with_lora(catalog(spark, sf_dir)))
    return r.withColumn("size_label", C.size_label(F.col("total_params"), F.col("shared_params"),
                                                   F.col("expert_params"), F.col("expert_count")))


def _with_sizes(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.withColumn("n_elements", C.n_elements(F.col("shape"))) \
        .withColumn("n_bytes", C.n_bytes(F.col("shape"), F.col("dtype")))


def groups(spark, sf_dir):
    r = C.group_rollup(_with_sizes(spark, sf_dir))
    return r.select("model", "group", "elements", "bytes", "first_pos",
                    F.round("pct", 6).alias("pct"), F.round("bits_per_weight", 6).alias("bits_per_weight"),
                    C.element_count_label(F.col("elements")).alias("label"))


def share(spark, sf_dir):
    per_role = _with_sizes(spark, sf_dir).groupBy("role").agg(F.sum("n_elements").alias("elements"))
    return C.share_of_total(per_role, "elements").select("role", "elements", F.round("pct", 6).alias("pct"))


def first_types(spark, sf_dir):
    return C.first_dtype(catalog(spark, sf_dir))


def dups(spark, sf_dir):
    return C.duplicates(catalog(spark, sf_dir), ["model"], "name")


def shards(spark, sf_dir):
    s = _with_sizes(spark, sf_dir).select("model", "pos", "n_bytes")
    # the plan feeds three consumers (numbering, offsets, output): write it once, and shuffle it once for them
    plan = materialize(C.plan_shards(s, "model", "pos", "n_bytes", SHARD_MAX_TENSORS, SHARD_MAX_BYTES),
                       "shard-plan").repartition("model")
    numbered = C.shard_numbering(plan, "model", "shard")
    off = C.aligned_offsets(numbered, ["model", "shard"], "pos", "n_bytes")
    return off.select("model", "pos", "shard", "split_no", "split_count", "split_tensors_count", "offset")


def shard_totals(spark, sf_dir):
    s = _with_sizes(spark, sf_dir).select("model", "pos", "n_bytes")
    plan = C.plan_shards(s, "model", "pos", "n_bytes", SHARD_MAX_TENSORS, SHARD_MAX_BYTES)
    tot = C.shard_totals(plan, ["model", "shard"])
    return tot.withColumn("human", C.human_bytes(F.col("bytes")))


def _qualified(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select(F.concat(F.col("model").cast("string"), F.lit("/"), F.col("name")).alias("name"),
                    F.concat(F.lit("model-"), F.col("model").cast("string"), F.lit("-of-"),
                             (F.col("pos") % 2 + 1).cast("string"), F.lit(".bin")).alias("file"),
                    "l_discount", "p_size")


def reconcile(spark, sf_dir):
    q = materialize(_qualified(spark, sf_dir), "catalog")  # both sides read it
    index = q.filter(F.col("l_discount") >= 0.01).select("name", "file")
    actual = q.filter(F.col("p_size") > 3).select("name")
    return C.reconcile(index, actual)


def symdiff(spark, sf_dir):
    q = materialize(_qualified(spark, sf_dir), "catalog")
    a = q.filter(F.col("l_discount") >= 0.01).select("name")
    b = q.filter(F.col("p_size") > 3).select("name")
    return C.symmetric_difference(a, b)


def mapped_names(spark, sf_dir):
    every = materialize(catalog(spark, sf_dir).select("model", "pos", "name", "role", "p_size"), "catalog")
    c = every.filter(~F.col("name").endswith(".rotary_emb.inv_freq"))
    src_role = F.create_map(*[x for k, v in SOURCE_ROLE.items() for x in (F.lit(k), F.lit(v))])[F.col("role")]
    sfx = F.regexp_extract("name", r"(\.[a-z_]+)$", 1)
    src = (F.when(F.col("role") == "token_embd", F.concat(F.lit("model.embed_tokens"), sfx))
           .when((F.col("role") == "attn_k") & (F.col("p_size") > 40),
                 F.concat(F.lit("model.layers."), (F.col("pos") - 1).cast("string"), F.lit(".self_attn.rotary"), sfx))
           .otherwise(F.concat(F.lit("model.layers."), (F.col("pos") - 1).cast("string"), F.lit("."), src_role, sfx)))
    names = c.select("model", "pos", src.alias("name"))
    n_blocks = every.select(F.max("pos")).scalar()
    pats = spark.createDataFrame(NAME_PATTERNS, "source string, target string, priority int")
    mapping = C.expand_mapping(pats, n_blocks)
    return C.map_names(names, mapping).select("model", "pos", "name", "mapped")


def merged_metadata(spark, sf_dir):
    cu = t(spark, sf_dir, "customer")
    seg, poor = F.col("c_mktsegment"), F.col("c_acctbal") < 0
    base = cu.select("c_custkey", F.explode(F.create_map(
        F.lit("general.name"), F.col("c_name"), F.lit("general.segment"), seg,
        F.lit("general.nation"), F.col("c_nationkey").cast("string"), F.lit("general.architecture"), F.lit("x"), F.lit("GGUF.version"), F.lit("3"),
        F.lit("tokenizer.chat_template"), F.lit("old"), F.lit("tokenizer.chat_template.tool"), F.lit("old tool"))).alias("key", "value"))
    o = t(spark, sf_dir, "orders")
    latest = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by(F.struct("o_orderpriority", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    new = latest.select("c_custkey", F.explode(F.create_map(
        F.lit("general.segment"), F.col("l.o_orderpriority"),
        F.lit("general.nation"), F.when(F.col("l.o_orderstatus") == "O", F.lit("new")),
        F.lit("general.status"), F.when(F.col("l.o_orderstatus") != "P", F.col("l.o_orderstatus")))).alias("key", "value"))
    template = latest.where(F.col("l.o_orderpriority").startswith("1")).select("c_custkey", F.lit("tokenizer.chat_template").alias("key"), F.lit("new").alias("value"))
    removed = cu.filter(poor).select("c_custkey", F.lit("general.nation").alias("key")) \
        .unionAll(cu.filter(poor).select("c_custkey", F.lit("general.segment").alias("key")))
    return C.merge_metadata(base, new.unionByName(template), removed, keys=["c_custkey", "key"])


def special_tokens(spark, sf_dir):
    types = t(spark, sf_dir, "nation").select(
        F.concat(F.lit("tok_"), F.col("n_nationkey").cast("string")).alias("type"), F.col("n_name").alias("content"))
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cu = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    added = cu.join(n, cu["c_nationkey"] == n["n_nationkey"]).select(
        F.col("n_name").alias("content"), (F.col("c_custkey") * 7 % 101 - 10).alias("id"), F.col("c_custkey").alias("pos"))
    return C.resolve_special(types, added, 60).select("type", "content", "id", "invalid")


#: A part becomes up to ten members, which the task sorts.
PARTS_A_TASK = 100_000


def canonical(spark, sf_dir):
    p = spread(t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), "p_partkey", PARTS_A_TASK)
    cfg = p.select(F.col("p_partkey").alias("entity"), F.explode(F.create_map(
        F.lit("hidden_size"), F.col("p_size").cast("string"),
        F.lit("n_embd"), F.when(F.col("p_size") > 25, (F.col("p_size") * 2).cast("string")),
        F.lit("dim"), (F.col("p_size") * 3).cast("string"),
        F.lit("rope_theta"), F.when(F.col("p_size") % 3 == 0, F.lit("10000.0")), F.lit("num_local_experts"), F.when(F.col("p_size") % 5 == 0, F.lit("8")),
        F.lit("num_experts_per_tok"), F.when(F.col("p_size") % 5 == 0, F.lit("2")), F.lit("n_group"), F.when(F.col("p_size") % 7 == 0, F.lit("4")),
        F.lit("topk_group"), F.when(F.col("p_size") % 7 == 1, F.lit("3")), F.lit("head_dim"), F.when(F.col("p_size") % 4 == 1, F.lit("128")),
        F.lit("n_ctx"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 100).cast("string")),
        F.lit("scoring_func"), F.when(F.col("p_type") == "SMALL", F.lit("sigmoid"))
        .when(F.col("p_type") == "LARGE", F.lit("softmax")).when(F.col("p_type") == "PROMO", F.lit("relu")))
    ).alias("key", "value")).filter(F.col("value").isNotNull())
    return C.canonical_keys(cfg, C.alias_table(spark))


def flattened(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    rec = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        "o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"),
                                         F.col("o_orderpriority").alias("priority"), "lines")).alias("record"))
    return C.flatten_kv(rec, "o_orderkey", "record")


def first_keys(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    js = (F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(F.struct(F.col("p_size").alias("hidden_size")).alias("text_config"))))
          .when(F.col("p_size") % 3 == 1, F.to_json(F.struct((F.col("p_size") * 2).alias("n_embd"))))
          .otherwise(F.to_json(F.struct(F.col("p_brand").alias("brand")))))
    v = F.try_parse_json(js)
    return p.select("p_partkey", C.first_key(v, ["hidden_size", "n_embd"]).try_cast("bigint").alias("width"))


def token_types(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    words = b.select(F.explode(F.split("text", " ")).alias("token"))
    made = b.select(F.explode(F.array(
        F.concat(F.lit("<0x"), F.lpad(F.upper(F.hex(F.col("item_id") % 256)), 2, "0"), F.lit(">")),
        F.concat(F.lit("<|item"), F.col("item_id").cast("string"), F.lit("|>")),
        F.concat(F.lit("<unused"), F.col("item_id").cast("string"), F.lit(">")))).alias("token"))
    toks = words.union(made).distinct()
    return toks.select("token", C.token_type(F.col("token")).alias("type"))


def vocab(spark, sf_dir):
    n_vocab = t(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 11
    special = F.concat(F.lit("<|"), F.col("c_name"), F.lit("|>"))
    base = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 7, special)
                                              .otherwise(F.col("c_name")).alias("token"), F.lit(0).alias("priority"))
    added = t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<unused"), F.col("s_suppkey").cast("string"), F.lit(">")))
        .otherwise(F.concat(F.lit("\u2581"), F.col("s_name"))).alias("token"), F.lit(1).alias("priority"))
    return densify(spark, base.unionByName(added), n_vocab)


def densify(spark, tokens, n_vocab):
    return C.densify_vocab(spark, tokens, n_vocab).select("id", "token", "toktype", F.round("score", 6).alias("score"))


def names_and_files(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    base = C.title_case_id(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    fname = C.artifact_filename(F.when(F.col("p_size") % 4 != 0, base), F.col("p_name"),
                                F.concat(F.col("p_size").cast("string"), F.lit("B")),
                                F.when(F.col("p_size") % 3 != 0, F.lower("p_type")), F.lit("v1.0"), F.lit("q8_0"))
    return p.select("p_partkey", fname.alias("file_name"),
                    C.shard_file_name(F.col("p_brand"), (F.col("p_partkey") % 5) + 1, F.lit(5)).alias("shard_name"),
                    C.fill_type_template(F.concat(F.col("p_brand"), F.lit(".{ftype}.{FTYPE}.gguf")),
                                         F.lit("Q8_0")).alias("templated"),
                    C.safe_name(F.concat(F.lit("models_"), F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("package"))


def sizes_parsed(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    s = F.concat(F.col("p_size").cast("string"),
                 F.when(F.col("p_size") % 5 == 0, "K").when(F.col("p_size") % 5 == 1, "M")
                 .when(F.col("p_size") % 5 == 2, "G").when(F.col("p_size") % 5 == 3, "").otherwise("X"))
    return p.select("p_partkey", s.alias("spec"), C.parse_size(s).alias("bytes"))


def previews(spark, sf_dir):
    # one part more than is shown tells whether there is more; the rest of a text stays in that part
    d = t(spark, sf_dir, "documents").withColumns({"words": F.split("text", " ", 8), "lines": F.split("text", "\n", 6)})
    lines = F.transform("lines", lambda x, i: F.when(i < 5, F.translate(x, "|", "`")).otherwise(F.lit("")))
    return d.select("doc_id", C.preview(F.col("text")).alias("preview"),
                    C.preview_ends(F.col("text")).alias("preview_ends"),
                    C.preview_array(F.col("words")).alias("preview_words"),
                    C.preview_strings(lines).alias("preview_lines"),
                    C.preview_numbers(F.transform("words", F.char_length)).alias("preview_lengths"))


def groups_complete(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("block"), F.col("l_returnflag").alias("projection"),
        (F.col("l_linenumber") - 1).alias("part"), F.array(F.col("l_quantity").cast("bigint")).alias("shape"))
    r = C.complete_groups(li, 2, ("A", "N", "R"))
    return r.select("block", "projection", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"),
                    "complete", F.array_join(F.col("merged_shape").cast("array<string>"), ",").alias("merged_shape"))


def digests(spark, sf_dir):
    c = catalog(spark, sf_dir).select("model", "pos", "name",
                                      F.concat_ws(",", F.col("name"), F.col("shape").cast("array<string>").cast("string"))
                                      .alias("data"))
    h = C.content_hashes(c, "data")
    h = h.withColumn("pos", F.col("pos") - 1)
    by_two = C.model_digest(h, "model", "pos", fan=2).withColumnRenamed("model_sha256", "by_two_sha256")
    return C.model_digest(h, "model", "pos").join(by_two, "model")


# ------------------------------------------------------------------ oracle SQL
_SQL_CAT = """cat AS (
  SELECT l.l_orderkey AS model,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS pos,
         l.l_returnflag, l.l_discount, p.p_size,
         CASE p.p_type WHEN 'STANDARD' THEN 'attn_q' WHEN 'MEDIUM' THEN 'attn_k' WHEN 'ECONOMY' THEN 'ffn_up_exps'
              WHEN 'LARGE' THEN 'ffn_down' WHEN 'SMALL' THEN 'attn_norm' WHEN 'PROMO' THEN 'token_embd' END AS role,
         CASE WHEN p.p_size % 9 = 0 THEN '.rotary_emb.inv_freq' WHEN l.l_returnflag = 'R' THEN '.bias' ELSE '.weight' END AS sfx,
         CAST(trunc(l.l_quantity) AS BIGINT) * 32 AS d1, CAST(p.p_size AS BIGINT) * 32 AS d2
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
cat2 AS (
  SELECT *, CASE WHEN role = 'token_embd' THEN role || sfx ELSE 'blk.' || (pos - 1) || '.' || role || sfx END AS name,
         CASE WHEN role = 'attn_norm' OR sfx = '.bias' THEN [d2]
              WHEN role = 'ffn_up_exps' THEN [4, d1, d2] ELSE [d1, d2] END AS shape
  FROM cat),
catalog AS (
  SELECT *, CASE WHEN len(shape) <= 1 THEN 'F32' WHEN l_discount < 0.05 THEN 'F16' ELSE 'BF16' END AS dtype,
         CAST(list_reduce(shape, lambda a, b: a * b) AS BIGINT) AS n_elements
  FROM cat2),
sized AS (
  SELECT *, CASE WHEN dtype = 'F32' THEN n_elements * 4 ELSE n_elements * 2 END AS n_bytes FROM catalog)"""


def _sql_human(x: str) -> str:
    return (f"CASE WHEN {x} = 0 THEN 'negligible - metadata only' "
            f"WHEN abs({x}) < 1e3 THEN printf('%3.1f', {x}::DOUBLE) "
            f"WHEN abs({x}) < 1e6 THEN printf('%3.1fK', {x} / 1e3) "
            f"WHEN abs({x}) < 1e9 THEN printf('%3.1fM', {x} / 1e6) "
            f"WHEN abs({x}) < 1e12 THEN printf('%3.1fG', {x} / 1e9) "
            f"ELSE printf('%.1fT - over 1TB, split recommended', {x} / 1e12) END")


def _sql_group(n: str) -> str:
    p = f"string_split({n}, '.')"
    return (f"CASE WHEN {p}[1] = 'blk' AND len({p}) >= 2 THEN {p}[1] || '.' || {p}[2] "
            f"WHEN {p}[1] IN ('enc', 'dec') AND {p}[2] = 'blk' AND len({p}) >= 3 THEN {p}[1] || '.' || {p}[2] || '.' || {p}[3] "
            f"WHEN {p}[1] IN ('enc', 'dec') THEN {p}[1] ELSE 'base' END")


def _sql_heading(g: str) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in C.ABBREVIATIONS.items() if "'" not in v)
    m = "MAP {" + pairs + "}"
    word = f"coalesce({m}[lower(trim(w))], w)"
    return (f"array_to_string(list_transform(string_split({g}, '.'), lambda w: "
            f"upper(left({word}, 1)) || lower(substr({word}, 2))), ' ')")


SQL_SIZES = f"""WITH {_SQL_CAT},
f AS (SELECT * FROM sized WHERE NOT (name LIKE '%.attention.masked_bias' OR name LIKE '%.attention.bias'
                                     OR name LIKE '%.rotary_emb.inv_freq'))
SELECT model, pos, name, n_elements, n_bytes, CAST(((n_bytes + 31) // 32) * 32 AS BIGINT) AS padded,
       {_sql_human('n_bytes')} AS human,
       TRY_CAST(list_filter(string_split(name, '.'), lambda x: regexp_full_match(x, '[0-9]+'))[1] AS INTEGER) AS block_id,
       {_sql_group('name')} AS "group", {_sql_heading(_sql_group('name'))} AS heading,
       array_to_string(list_reverse(shape), 'x') AS disk_dims
FROM f"""

SQL_STORAGE = f"""WITH {_SQL_CAT}
SELECT model, pos, name, CASE WHEN model % 2 = 0 THEN 'Q8_0' ELSE 'TQ1_0' END AS requested,
       CASE WHEN len(shape) <= 1 OR name LIKE '%_norm.weight' THEN
                 CASE WHEN shape[-1] % 1 <> 0 THEN 'F16' ELSE 'F32' END
            WHEN NOT (name LIKE '%.weight' OR name LIKE '%.lora_a' OR name LIKE '%.lora_b') THEN 'F32'
            WHEN model % 2 <> 0 AND regexp_full_match(name, '(token_embd|per_layer_token_embd|output)\\.[^.]+') THEN 'F16'
            WHEN model % 2 = 0 THEN CASE WHEN shape[-1] % 32 <> 0 THEN 'F16' ELSE 'Q8_0' END
            ELSE CASE WHEN shape[-1] % 256 <> 0 THEN 'F16' ELSE 'TQ1_0' END END AS storage
FROM catalog"""


def _sql_count_label(x: str) -> str:
    sc = (f"CASE WHEN {x} > 1e12 THEN {x} * 1e-12 WHEN {x} > 1e9 THEN {x} * 1e-9 "
          f"WHEN {x} > 1e6 THEN {x} * 1e-6 ELSE {x} * 1e-3 END")
    sfx = f"CASE WHEN {x} > 1e12 THEN 'T' WHEN {x} > 1e9 THEN 'B' WHEN {x} > 1e6 THEN 'M' ELSE 'K' END"
    digits = f"length(ltrim(CAST(CAST(round_even({sc}, 0) AS BIGINT) AS VARCHAR), '0'))"
    fix = f"greatest(2 - {digits}, 0)"
    return f"printf('%.' || {fix} || 'f', {sc}) || {sfx}"


SQL_PARAM_COUNT = f"""WITH {_SQL_CAT},
x AS (
  SELECT model, shape, pos * 4 + step AS pos, name || suffix AS name FROM (
    SELECT *, unnest(CASE WHEN p_size % 5 = 1 THEN [0, 1, 2] ELSE [0] END) AS step,
           unnest(CASE WHEN p_size % 5 = 1 THEN ['.lora_a', '.mid', '.lora_b'] WHEN p_size % 25 = 2 THEN ['.lora_b'] ELSE [''] END) AS suffix FROM catalog)),
y AS (
  SELECT *, last_value(CASE WHEN name LIKE '%.lora\\_a' ESCAPE '\\' THEN name END IGNORE NULLS) OVER w AS an,
         last_value(CASE WHEN name LIKE '%.lora\\_a' ESCAPE '\\' THEN shape[-1] END IGNORE NULLS) OVER w AS ad
  FROM x WINDOW w AS (PARTITION BY model ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (
  SELECT model, name, CASE WHEN name LIKE '%.lora\\_b' ESCAPE '\\' AND an = name[:-2] || 'a' THEN list_concat(shape[:-2], [ad]) ELSE shape END AS shape,
         CASE WHEN name LIKE '%.lora\\_b' ESCAPE '\\' AND an IS DISTINCT FROM name[:-2] || 'a' THEN 1 ELSE 0 END AS bad,
         CASE WHEN name LIKE '%.lora\\_a' ESCAPE '\\' THEN 1 ELSE 0 END AS is_a FROM y),
lo AS (SELECT model, max(bad) AS bad, max(is_a) AS lora FROM z GROUP BY model),
e AS (
  SELECT model, name, CAST(list_reduce(shape, lambda a, b: a * b) AS BIGINT) AS size, name LIKE '%\\_exps.%' ESCAPE '\\' AS is_exp,
         CAST(CASE WHEN name LIKE '%.bias%' THEN CASE WHEN len(shape) >= 2 THEN shape[-2] ELSE shape[-1] END
              ELSE CASE WHEN len(shape) >= 3 THEN shape[-3] ELSE shape[-1] END END AS BIGINT) AS ec
  FROM z WHERE is_a = 0),
r0 AS (
  SELECT model, sum(size) AS total, sum(CASE WHEN NOT is_exp THEN size ELSE 0 END) AS shared,
         sum(CASE WHEN is_exp THEN size // ec ELSE 0 END) AS expert,
         sum(CASE WHEN is_exp THEN ec ELSE 0 END) AS esum, sum(CASE WHEN is_exp THEN 1 ELSE 0 END) AS en
  FROM e GROUP BY model),
r AS (
  SELECT model, CASE WHEN bad = 1 THEN 0 WHEN lora = 1 THEN -total ELSE total END AS total, CASE WHEN bad = 1 THEN 0 ELSE shared END AS shared,
         CASE WHEN bad = 1 THEN 0 ELSE expert END AS expert, esum, CASE WHEN bad = 1 THEN 0 ELSE en END AS en
  FROM r0 JOIN lo USING (model))
SELECT model, CAST(total AS BIGINT) AS total_params, CAST(shared AS BIGINT) AS shared_params,
       CAST(expert AS BIGINT) AS expert_params, CAST(CASE WHEN en = 0 THEN 0 ELSE esum // en END AS BIGINT) AS expert_count,
       CASE WHEN en > 0 THEN CAST(esum // en AS VARCHAR) || 'x' || {_sql_count_label('(abs(shared) + abs(expert))::DOUBLE')}
            ELSE {_sql_count_label('abs(total)::DOUBLE')} END AS size_label
FROM r"""


def _sql_elabel(x: str) -> str:
    sc = (f"CASE WHEN {x} > 1e15 THEN {x} * 1e-15 WHEN {x} > 1e12 THEN {x} * 1e-12 WHEN {x} > 1e9 THEN {x} * 1e-9 "
          f"WHEN {x} > 1e6 THEN {x} * 1e-6 WHEN {x} > 1e3 THEN {x} * 1e-3 ELSE {x} END")
    sfx = (f"CASE WHEN {x} > 1e15 THEN 'Q' WHEN {x} > 1e12 THEN 'T' WHEN {x} > 1e9 THEN 'B' "
           f"WHEN {x} > 1e6 THEN 'M' WHEN {x} > 1e3 THEN 'K' ELSE '' END")
    return f"CASE WHEN {x} > 1e3 THEN '~' ELSE '' END || CAST(CAST(round_even({sc}, 0) AS BIGINT) AS VARCHAR) || {sfx}"


SQL_GROUPS = f"""WITH {_SQL_CAT},
g AS (SELECT *, {_sql_group('name')} AS grp FROM sized),
r AS (
  SELECT model, grp AS "group", CAST(sum(n_elements) AS BIGINT) AS elements, CAST(sum(n_bytes) AS BIGINT) AS bytes,
         min(pos) AS first_pos
  FROM g GROUP BY ROLLUP (model, grp) HAVING model IS NOT NULL),
t AS (SELECT model, elements AS tot FROM r WHERE "group" IS NULL)
SELECT r.model, r."group", r.elements, r.bytes, r.first_pos, round(r.elements * 100.0 / t.tot, 6) AS pct,
       round(CASE WHEN r.elements > 0 THEN r.bytes * 8.0 / r.elements END, 6) AS bits_per_weight,
       {_sql_elabel('r.elements')} AS label
FROM r JOIN t ON r.model = t.model"""

SQL_SHARE = f"""WITH {_SQL_CAT},
r AS (SELECT role, sum(n_elements) AS elements FROM catalog GROUP BY role)
SELECT role, CAST(elements AS BIGINT) AS elements, round(elements * 100.0 / (SELECT sum(elements) FROM r), 6) AS pct FROM r"""

SQL_FIRST_TYPES = f"""WITH {_SQL_CAT}
SELECT model, arg_min(dtype, pos) AS first_dtype,
       CASE WHEN lower(arg_min(dtype, pos)) IN ('f16', 'float16') THEN 'F16' ELSE 'BF16' END AS default_type
FROM catalog GROUP BY model"""

SQL_DUPS = f"""WITH {_SQL_CAT}
SELECT model, name, CAST(count(*) AS BIGINT) AS n FROM catalog GROUP BY model, name HAVING count(*) > 1"""

_SQL_SHARDS = f"""{_SQL_CAT},
s AS (SELECT model, pos, n_bytes, row_number() OVER (PARTITION BY model ORDER BY pos) AS rn FROM sized),
r AS (
  SELECT model, rn, pos, n_bytes, 0 AS shard, 1 AS cnt, n_bytes AS sz FROM s WHERE rn = 1
  UNION ALL
  SELECT s.model, s.rn, s.pos, s.n_bytes,
         CASE WHEN r.cnt >= {SHARD_MAX_TENSORS} OR r.sz + s.n_bytes > {SHARD_MAX_BYTES} THEN r.shard + 1 ELSE r.shard END,
         CASE WHEN r.cnt >= {SHARD_MAX_TENSORS} OR r.sz + s.n_bytes > {SHARD_MAX_BYTES} THEN 1 ELSE r.cnt + 1 END,
         CASE WHEN r.cnt >= {SHARD_MAX_TENSORS} OR r.sz + s.n_bytes > {SHARD_MAX_BYTES} THEN s.n_bytes ELSE r.sz + s.n_bytes END
  FROM r JOIN s ON s.model = r.model AND s.rn = r.rn + 1)"""

SQL_SHARDS = f"""WITH RECURSIVE {_SQL_SHARDS},
n AS (SELECT model, max(shard) + 1 AS split_count, count(*) AS split_tensors_count FROM r GROUP BY model)
SELECT r.model, r.pos, CAST(r.shard AS BIGINT) AS shard, CAST(r.shard AS INTEGER) AS split_no,
       CAST(n.split_count AS INTEGER) AS split_count, CAST(n.split_tensors_count AS BIGINT) AS split_tensors_count,
       CAST(coalesce(sum(((r.n_bytes + 31) // 32) * 32) OVER (PARTITION BY r.model, r.shard ORDER BY r.pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
FROM r JOIN n ON r.model = n.model"""

SQL_SHARD_TOTALS = f"""WITH RECURSIVE {_SQL_SHARDS},
t AS (SELECT model, CAST(shard AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n_tensors,
             CAST(sum(n_bytes) AS BIGINT) AS bytes FROM r GROUP BY model, shard)
SELECT model, shard, n_tensors, bytes, {_sql_human('bytes')} AS human FROM t"""

_SQL_Q = f"""{_SQL_CAT},
q AS (SELECT model || '/' || name AS name, 'model-' || model || '-of-' || (pos % 2 + 1) || '.bin' AS file,
             l_discount, p_size FROM catalog),
a AS (SELECT name, file FROM q WHERE l_discount >= 0.01),
b AS (SELECT DISTINCT name FROM q WHERE p_size > 3)"""

SQL_RECONCILE = f"""WITH {_SQL_Q}
SELECT name, 'missing' AS side, file FROM a WHERE name NOT IN (SELECT name FROM b)
UNION ALL
SELECT name, 'extra' AS side, NULL AS file FROM b WHERE name NOT IN (SELECT name FROM a)"""

SQL_SYMDIFF = f"""WITH {_SQL_Q}
(SELECT name FROM a EXCEPT SELECT name FROM b) UNION (SELECT name FROM b EXCEPT SELECT name FROM a)"""

SQL_MAPPED = f"""WITH {_SQL_CAT},
c AS (SELECT * FROM catalog WHERE NOT name LIKE '%.rotary_emb.inv_freq'),
n AS (
  SELECT model, pos, role, regexp_extract(name, '(\\.[a-z_]+)$', 1) AS sfx,
         CASE WHEN role = 'token_embd' THEN 'model.embed_tokens' || regexp_extract(name, '(\\.[a-z_]+)$', 1)
              WHEN role = 'attn_k' AND p_size > 40 THEN 'model.layers.' || (pos - 1) || '.self_attn.rotary' || regexp_extract(name, '(\\.[a-z_]+)$', 1)
              ELSE 'model.layers.' || (pos - 1) || '.' || CASE role WHEN 'attn_q' THEN 'self_attn.q_proj'
                   WHEN 'attn_k' THEN 'self_attn.k_proj' WHEN 'ffn_up_exps' THEN 'mlp.experts.up_proj'
                   WHEN 'ffn_down' THEN 'mlp.down_proj' WHEN 'attn_norm' THEN 'input_layernorm' END
                   || regexp_extract(name, '(\\.[a-z_]+)$', 1) END AS name
  FROM c),
nb AS (SELECT max(pos) AS n FROM catalog),
pats(source, target) AS (VALUES ('model.embed_tokens', 'token_embd'),
  ('model.layers.{{bid}}.self_attn.q_proj', 'blk.{{bid}}.attn_q'), ('model.layers.{{bid}}.self_attn.k_proj', 'blk.{{bid}}.attn_k'),
  ('model.layers.{{bid}}.mlp.down_proj', 'blk.{{bid}}.ffn_down'), ('model.layers.{{bid}}.input_layernorm', 'blk.{{bid}}.attn_norm'),
  ('model.layers.{{bid}}.mlp.experts.up_proj', 'blk.{{bid}}.ffn_up_exps')),
m AS (
  SELECT replace(source, '{{bid}}', CAST(b AS VARCHAR)) AS source, replace(target, '{{bid}}', CAST(b AS VARCHAR)) AS target
  FROM pats, nb, range(0, nb.n) r(b) WHERE contains(source, '{{bid}}')
  UNION ALL SELECT source, target FROM pats WHERE NOT contains(source, '{{bid}}'))
SELECT n.model, n.pos, n.name,
       coalesce(e.target, s.target || CASE WHEN n.name LIKE '%.weight' THEN '.weight' WHEN n.name LIKE '%.bias' THEN '.bias' END) AS mapped
FROM n LEFT JOIN m e ON n.name = e.source
LEFT JOIN m s ON s.source = CASE WHEN n.name LIKE '%.weight' THEN left(n.name, length(n.name) - 7)
                                 WHEN n.name LIKE '%.bias' THEN left(n.name, length(n.name) - 5) END"""

SQL_MERGED = """
WITH l AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr,
             arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY o_custkey),
new AS (
  SELECT c_custkey, 'general.segment' AS key, pr AS value FROM l
  UNION ALL SELECT c_custkey, 'general.nation', CASE WHEN st = 'O' THEN 'new' END FROM l
  UNION ALL SELECT c_custkey, 'general.status', CASE WHEN st <> 'P' THEN st END FROM l
  UNION ALL SELECT c_custkey, 'tokenizer.chat_template', 'new' FROM l WHERE starts_with(pr, '1')),
base AS (
  SELECT c_custkey, 'general.name' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'general.segment', c_mktsegment FROM customer WHERE NOT c_acctbal < 0
  UNION ALL SELECT c_custkey, 'general.nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE NOT c_acctbal < 0
  UNION ALL SELECT c_custkey, unnest(['tokenizer.chat_template', 'tokenizer.chat_template.tool']), unnest(['old', 'old tool']) FROM customer
    WHERE c_custkey NOT IN (SELECT c_custkey FROM l WHERE starts_with(pr, '1')))
SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, coalesce(b.key, n.key) AS key,
       CASE WHEN n.key IS NOT NULL THEN n.value ELSE b.value END AS value,
       CASE WHEN n.key IS NOT NULL AND b.key IS NOT NULL THEN 'replaced' WHEN n.key IS NOT NULL THEN 'added' ELSE 'kept' END AS origin
FROM base b FULL OUTER JOIN new n ON b.c_custkey = n.c_custkey AND b.key = n.key
WHERE CASE WHEN n.key IS NOT NULL THEN n.value ELSE b.value END IS NOT NULL"""

SQL_SPECIAL = """
WITH f AS (
  SELECT n.n_name AS content, arg_min(c.c_custkey * 7 % 101 - 10, c.c_custkey) AS id
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1)
SELECT 'tok_' || n.n_nationkey AS type, n.n_name AS content, CASE WHEN f.id >= 0 AND f.id < 60 THEN f.id END AS id, coalesce(f.id < 0, false) AS invalid
FROM nation n LEFT JOIN f ON f.content = n.n_name"""

SQL_CANONICAL = """
WITH cfg AS (
  SELECT p_partkey AS entity, 'hidden_size' AS key, CAST(p_size AS VARCHAR) AS value FROM part
  UNION ALL SELECT p_partkey, 'n_embd', CAST(p_size * 2 AS VARCHAR) FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 'dim', CAST(p_size * 3 AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 'n_ctx', CAST(p_size * 100 AS VARCHAR) FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'scoring_func', CASE p_type WHEN 'SMALL' THEN 'sigmoid' WHEN 'LARGE' THEN 'softmax'
                                                          WHEN 'PROMO' THEN 'relu' END FROM part
            WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')
  UNION ALL SELECT p_partkey, 'rope_theta', '10000.0' FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, unnest(['num_local_experts', 'num_experts_per_tok']), unnest(['8', '2']) FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT p_partkey, 'n_group', '4' FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 'topk_group', '3' FROM part WHERE p_size % 7 = 1
  UNION ALL SELECT p_partkey, 'head_dim', '128' FROM part WHERE p_size % 4 = 1),
al(alias, canonical, priority) AS (VALUES
  ('max_position_embeddings', 'context_length', 0), ('n_ctx', 'context_length', 1),
  ('n_positions', 'context_length', 2), ('max_length', 'context_length', 3),
  ('hidden_size', 'embedding_length', 0), ('n_embd', 'embedding_length', 1), ('dim', 'embedding_length', 2),
  ('score_function', 'expert_gating_func', 0), ('scoring_func', 'expert_gating_func', 1),
  ('score_func', 'expert_gating_func', 2), ('rope_theta', 'rope_freq_base', 0), ('num_local_experts', 'expert_count', 0),
  ('num_experts_per_tok', 'expert_used_count', 0), ('n_group', 'expert_group_count', 0), ('topk_group', 'expert_group_used_count', 0),
  ('head_dim', 'attention_key_length', 0), ('head_dim', 'attention_value_length', 0)),
r AS (SELECT entity, canonical, arg_min(value, priority) AS value, arg_min(alias, priority) AS alias
      FROM cfg JOIN al ON cfg.key = al.alias GROUP BY entity, canonical)
SELECT entity, canonical,
       CASE WHEN canonical = 'expert_gating_func' THEN CASE value WHEN 'softmax' THEN '1' WHEN 'sigmoid' THEN '2' END
            ELSE value END AS value, alias,
       canonical = 'expert_gating_func' AND value NOT IN ('softmax', 'sigmoid') AS invalid
FROM r"""

SQL_FLATTENED = """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)
SELECT o_orderkey, 'status' AS key, '"' || o_orderstatus || '"' AS value FROM o
UNION ALL SELECT o_orderkey, 'priority', '"' || o_orderpriority || '"' FROM o
UNION ALL SELECT l_orderkey, 'lines.count', CAST(count(*) AS VARCHAR) FROM l GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1) || '.n',
                 CAST(l_linenumber AS VARCHAR) FROM l
UNION ALL SELECT l_orderkey, 'lines.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1) || '.flag',
                 '"' || l_returnflag || '"' FROM l"""

SQL_FIRST_KEYS = """
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_size * 2 END AS BIGINT) AS width FROM part"""

SQL_TOKEN_TYPES = """
WITH w AS (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark
           UNION SELECT '<0x' || lpad(upper(to_hex(item_id % 256)), 2, '0') || '>' FROM benchmark
           UNION SELECT '<|item' || item_id || '|>' FROM benchmark
           UNION SELECT '<unused' || item_id || '>' FROM benchmark)
SELECT DISTINCT token, CASE WHEN regexp_full_match(token, '<0x[0-9A-Fa-f]{2}>') THEN 'BYTE'
       WHEN (starts_with(token, '<|') AND ends_with(token, '|>')) OR (starts_with(token, '<｜') AND ends_with(token, '｜>'))
            OR (starts_with(token, '<unused') AND ends_with(token, '>')) OR token IN ('<pad>', '<mask>', '<2mass>', '[@BOS@]')
       THEN 'CONTROL' ELSE 'NORMAL' END AS type FROM w"""

SQL_VOCAB = """
WITH n AS (SELECT max(c_custkey) + 11 AS n FROM customer),
toks AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 7 THEN '<|' || c_name || '|>' ELSE c_name END AS token, 0 AS pr FROM customer
  UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '<unused' || s_suppkey || '>' ELSE chr(9601) || s_name END, 1 FROM supplier),
best AS (SELECT id, arg_max(token, pr) AS token, max(pr) AS pr FROM toks, n WHERE id >= 0 AND id < n.n GROUP BY id),
ids AS (SELECT range AS id FROM n, range(0, n.n))
SELECT ids.id, coalesce(CASE WHEN best.pr > 0 AND NOT starts_with(best.token, '<') THEN replace(best.token, chr(9601), ' ') ELSE best.token END,
                        '[PAD' || ids.id || ']') AS token,
       CAST(CASE WHEN best.token IS NULL THEN 5
                 WHEN best.pr = 0 THEN 1 WHEN starts_with(best.token, '<unused') AND ends_with(best.token, '>') THEN 3
                 ELSE 4 END AS INTEGER) AS toktype,
       round(CASE WHEN best.token IS NULL THEN -10000.0 WHEN best.pr > 0 THEN -1000.0 ELSE 0.0 END, 6) AS score
FROM ids LEFT JOIN best ON ids.id = best.id"""

SQL_NAMES = """
WITH w AS (SELECT p_partkey, p_brand, p_size, p_type, p_name,
                  list_transform(string_split(replace(replace(p_name, ' ', '-'), '-', ' '), ' '),
                    lambda x: CASE WHEN x = lower(x) AND regexp_matches(x, '[a-z]')
                                    AND NOT regexp_full_match(x, '(v[0-9]+(\\.[0-9]+)*|[0-9].*)')
                                   THEN upper(left(x, 1)) || substr(x, 2) ELSE x END) AS ws FROM part)
SELECT p_partkey,
       CASE WHEN p_size % 4 <> 0 THEN replace(replace(array_to_string(ws, ' '), ' ', '-'), '/', '-')
            ELSE replace(replace(trim(p_name), ' ', '-'), '/', '-') END
       || '-' || p_size || 'B' || CASE WHEN p_size % 3 <> 0 THEN '-' || lower(p_type) ELSE '' END || '-v1.0-Q8_0' AS file_name,
       p_brand || '-' || lpad(CAST(p_partkey % 5 + 1 AS VARCHAR), 5, '0') || '-of-00005.gguf' AS shard_name,
       p_brand || '.q8_0.Q8_0.gguf' AS templated,
       regexp_replace('models_' || p_brand || ' ' || p_type, '[^A-Za-z0-9_.\\-]', '_', 'g') AS package
FROM w"""

SQL_SIZES_PARSED = """
WITH s AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_size % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G'
                  WHEN 3 THEN '' ELSE 'X' END AS spec FROM part)
SELECT p_partkey, spec,
       CASE WHEN regexp_full_match(spec, '[0-9]+[KMG]?') THEN
            CAST(regexp_extract(spec, '^([0-9]+)', 1) AS BIGINT) *
            CASE right(spec, 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'G' THEN 1000000000 ELSE 1 END END AS bytes
FROM s"""

def _sql_code(x: str) -> str:
    mark = f"repeat('`', 1 + CAST(coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r))), 0) AS BIGINT))"
    pad = f"CASE WHEN starts_with({x}, '`') OR ends_with({x}, '`') THEN ' ' ELSE '' END"
    return f"({mark} || {pad} || {x} || {pad} || {mark})"


SQL_PREVIEWS = """
SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS preview,
       CASE WHEN length(text) > 60 THEN left(text, 30) || '...' || right(text, 30) ELSE text END AS preview_ends,
       '[ ' || array_to_string(list_slice(string_split(text, ' '), 1, 6), ', ')
           || CASE WHEN len(string_split(text, ' ')) > 6 THEN ', ...' ELSE '' END || ' ]' AS preview_words,
       '[ ' || trim(array_to_string(list_transform(list_slice(ls, 1, 5), lambda x: CASE WHEN length(x) > 30
           THEN """ + _sql_code("left(x, 15)") + """ || '...' || """ + _sql_code("right(x, 15)") + """ ELSE """ + _sql_code("x") + """ END), ', '))
           || CASE WHEN len(ls) > 5 THEN ', ...' ELSE '' END || ' ]' AS preview_lines,
       '[ ' || array_to_string(list_transform(list_slice(string_split(text, ' '), 1, 7), lambda x: CAST(length(x) AS VARCHAR)), ', ')
           || CASE WHEN len(string_split(text, ' ')) > 7 THEN ', ...' ELSE '' END || ' ]' AS preview_lengths
FROM (SELECT *, string_split(translate(text, '|', '`'), chr(10)) AS ls FROM documents)"""

SQL_GROUPS_COMPLETE = """
WITH o AS (SELECT l_partkey AS block, l_returnflag AS projection, l_linenumber - 1 AS part, min(CAST(trunc(l_quantity) AS BIGINT)) AS q
           FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT block FROM o WHERE projection IN ('A', 'N', 'R') AND part IN (0, 1) GROUP BY block HAVING count(*) = 6)
SELECT block, projection, array_to_string(list_sort(list(part)), ',') AS parts, block IN (SELECT block FROM w) AS complete,
       CASE WHEN block IN (SELECT block FROM w) THEN '2,' || CAST(min(CASE WHEN part = 0 THEN q END) AS VARCHAR) END AS merged_shape
FROM o GROUP BY 1, 2"""

SQL_MODEL_DIGEST = f"""WITH {_SQL_CAT},
t AS (SELECT model, pos - 1 AS q, sha256(name || ',' || '[' || array_to_string(shape, ', ') || ']') AS d, max(pos - 1) OVER (PARTITION BY model) AS top FROM catalog),
-- one level of two for every open model, as long as there is one
l1 AS (SELECT model, q // 2 AS q, top // 2 AS top, sha256(string_agg(d, '' ORDER BY q)) AS d FROM t GROUP BY model, t.q // 2, top // 2),
l2 AS (SELECT model, q // 2 AS q, top // 2 AS top, CASE WHEN any_value(top) > 0 THEN sha256(string_agg(d, '' ORDER BY q)) ELSE any_value(d) END AS d FROM l1 GROUP BY model, l1.q // 2, l1.top // 2),
l3 AS (SELECT model, q // 2 AS q, top // 2 AS top, CASE WHEN any_value(top) > 0 THEN sha256(string_agg(d, '' ORDER BY q)) ELSE any_value(d) END AS d FROM l2 GROUP BY model, l2.q // 2, l2.top // 2),
l4 AS (SELECT model, q // 2 AS q, top // 2 AS top, CASE WHEN any_value(top) > 0 THEN sha256(string_agg(d, '' ORDER BY q)) ELSE any_value(d) END AS d FROM l3 GROUP BY model, l3.q // 2, l3.top // 2),
l5 AS (SELECT model, q // 2 AS q, top // 2 AS top, CASE WHEN any_value(top) > 0 THEN sha256(string_agg(d, '' ORDER BY q)) ELSE any_value(d) END AS d FROM l4 GROUP BY model, l4.q // 2, l4.top // 2)
SELECT model, model_sha256, l5.d AS by_two_sha256 FROM l5 JOIN (SELECT model, sha256(string_agg(d, '' ORDER BY q)) AS model_sha256 FROM t GROUP BY model) USING (model)"""

QUERIES = {
    "cat_tensor_sizes": (sizes, SQL_SIZES),
    "cat_storage_type": (storage, SQL_STORAGE),
    "cat_parameter_count": (param_count, SQL_PARAM_COUNT),
    "cat_group_rollup": (groups, SQL_GROUPS),
    "cat_share_of_total": (share, SQL_SHARE),
    "cat_first_dtype": (first_types, SQL_FIRST_TYPES),
    "cat_duplicates": (dups, SQL_DUPS),
    "cat_plan_shards": (shards, SQL_SHARDS),
    "cat_shard_totals": (shard_totals, SQL_SHARD_TOTALS),
    "cat_reconcile": (reconcile, SQL_RECONCILE),
    "cat_symmetric_difference": (symdiff, SQL_SYMDIFF),
    "cat_map_names": (mapped_names, SQL_MAPPED),
    "cat_merge_metadata": (merged_metadata, SQL_MERGED),
    "cat_resolve_special": (special_tokens, SQL_SPECIAL),
    "cat_canonical_keys": (canonical, SQL_CANONICAL),
    "cat_flatten_kv": (flattened, SQL_FLATTENED),
    "cat_first_key": (first_keys, SQL_FIRST_KEYS),
    "cat_token_type": (token_types, SQL_TOKEN_TYPES),
    "cat_densify_vocab": (vocab, SQL_VOCAB),
    "cat_artifact_names": (names_and_files, SQL_NAMES),
    "cat_parse_size": (sizes_parsed, SQL_SIZES_PARSED),
    "cat_preview": (previews, SQL_PREVIEWS),
    "cat_complete_groups": (groups_complete, SQL_GROUPS_COMPLETE),
    "cat_model_digest": (digests, SQL_MODEL_DIGEST),
}
