"""CAT operators: labels, sizes, storage rules, shard planning."""

from pyspark.sql import functions as F

from tallyframe.operators import catalog as C


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_count_labels(spark):
    ns = [7_241_732_096, 124_000_000, 1_250, 65, 1_000_000_000_001, 999_999]
    got = _one(spark, C.count_label(F.col("n")), [(n,) for n in ns], "n long")

    def ref(n):
        if n > 1e12:
            s, u = n * 1e-12, "T"
        elif n > 1e9:
            s, u = n * 1e-9, "B"
        elif n > 1e6:
            s, u = n * 1e-6, "M"
        else:
            s, u = n * 1e-3, "K"
        fix = max(2 - len(str(round(s)).lstrip("0")), 0)
        return f"{s:.{fix}f}{u}"
    assert got == [ref(n) for n in ns]


def test_human_bytes(spark):
    ns = [0, 999, 1000, 1_250_000, 3_000_000_000, 5_000_000_000_000]
    got = _one(spark, C.human_bytes(F.col("n")), [(n,) for n in ns], "n long")
    assert got == ["negligible - metadata only", "999.0", "1.0K", "1.2M", "3.0G", "5.0T - over 1TB, split recommended"]


def test_group_key_and_block_id(spark):
    names = ["blk.3.attn_q.weight", "enc.blk.1.ffn_up.weight", "dec.output.weight", "token_embd.weight"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(C.group_key(F.col("n")).alias("g"), C.block_id(F.col("n")).alias("b")).collect()
    assert [r.g for r in rows] == ["blk.3", "enc.blk.1", "dec", "base"]
    assert [r.b for r in rows] == [3, 1, None, None]
    assert _one(spark, C.expand_abbrev(F.col("n")), [("blk.3",)], "n string") == ["Block 3"]


def test_storage_rules(spark):
    rows = [("blk.0.attn_norm.weight", 1, "Q8_0", 64), ("blk.0.ffn_gate_inp.weight", 2, "Q8_0", 64),
            ("token_embd.weight", 2, "TQ1_0", 512), ("blk.0.attn_q.weight", 2, "Q8_0", 48),
            ("blk.0.attn_q.weight", 2, "Q8_0", 64), ("blk.0.attn_q.bias", 2, "Q8_0", 64)]
    df = spark.createDataFrame(rows, "n string, nd int, req string, last long")
    got = [r.t for r in df.select(C.storage_type(F.col("n"), F.col("nd"), F.col("req"),
                                                 last_dim=F.col("last")).alias("t")).collect()]
    assert got == ["F32", "F32", "F16", "F16", "Q8_0", "F32"]


def test_plan_shards_greedy(spark):
    sizes = [5, 5, 1, 9, 2, 2, 2, 2, 10, 1]
    rows = [(m, i, s) for m in (1, 2) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "model long, pos long, nbytes long")
    got = {(r.model, r.pos): r.shard for r in C.plan_shards(df, "model", "pos", "nbytes", 3, 10).collect()}
    shard, cnt, size, want = 0, 0, 0, []
    for s in sizes:
        if cnt > 0 and (cnt >= 3 or size + s > 10):
            shard, cnt, size = shard + 1, 0, 0
        want.append(shard)
        cnt += 1
        size += s
    assert [got[(1, i)] for i in range(len(sizes))] == want
    assert [got[(2, i)] for i in range(len(sizes))] == want


def test_aligned_offsets(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([10, 33, 64, 1])], "m long, pos long, nb long")
    got = [r.offset for r in C.aligned_offsets(df, ["m"], "pos", "nb", bucket_rows=2).orderBy("pos").collect()]
    assert got == [0, 32, 96, 160]


def test_map_names_suffix(spark):
    m = spark.createDataFrame([("a.b", "x.y", 0), ("l.{bid}.q", "blk.{bid}.q", 0)], "source string, target string, priority int")
    mapping = C.expand_mapping(m, 2)
    names = spark.createDataFrame([("a.b",), ("a.b.weight",), ("l.1.q.bias",), ("zz.weight",)], "name string")
    got = [r.mapped for r in C.map_names(names, mapping).orderBy("name").collect()]
    assert got == ["x.y", "x.y.weight", "blk.1.q.bias", None]


def test_plan_shards_count_only(spark):
    rows = [(1, p, 10) for p in (5, 9, 12, 40, 41, 5000, 9000)] + [(2, 3, 1)]
    df = spark.createDataFrame(rows, "model long, pos long, nbytes long")
    got = sorted((r.model, r.pos, r.shard) for r in C.plan_shards(df, "model", "pos", "nbytes", 3).collect())
    assert got == [(1, 5, 0), (1, 9, 0), (1, 12, 0), (1, 40, 1), (1, 41, 1), (1, 5000, 1), (1, 9000, 2), (2, 3, 0)]


def test_plan_shards_equals_greedy(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = []
    for m in range(3):
        n = [1, 37, 200][m]
        for i in range(n):
            rows.append((m, int(rng.integers(0, 10_000_000)) * 10 + i % 10, int(rng.choice([0, 1, 3, 7, 12, 40]))))
    df = spark.createDataFrame(rows, "model long, pos long, nbytes long")
    for max_t, max_b in ((0, 20), (5, 20)):
        got = {(r.model, r.pos): r.shard for r in
               C.plan_shards(df, "model", "pos", "nbytes", max_t, max_b).collect()}
        for m in range(3):
            seq = sorted((p, b) for mm, p, b in rows if mm == m)
            shard, cnt, size = 0, 0, 0
            for p, b in seq:
                if cnt > 0 and ((max_t and cnt >= max_t) or size + b > max_b):
                    shard, cnt, size = shard + 1, 0, 0
                assert got[(m, p)] == shard, (max_t, max_b, m, p)
                cnt += 1
                size += b


def test_plan_shards_over_many_blocks(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(C, "RANKS", 8)
    rng = np.random.default_rng(5)
    sizes = {1: rng.choice([0, 1, 3, 7, 12, 40, 900], 700).tolist(), 2: [0] * 50 + [5] * 120 + [0] * 30, 3: [10 ** 6] + [1] * 200, 4: [1] * 200 + [10 ** 6] + [0] * 20, 5: [None, 3]}
    df = spark.createDataFrame([(m, p, b) for m, v in sizes.items() for p, b in enumerate(v)], "model long, pos long, nbytes long")
    for max_t, max_b in ((0, 20), (6, 50), (0, 10 ** 7), (3, 1)):
        got = {(r.model, r.pos): r.shard for r in C.plan_shards(df, "model", "pos", "nbytes", max_t, max_b).collect()}
        for m, v in sizes.items():
            shard, cnt, size = 0, 0, 0
            for p, b in enumerate(v):
                b = b or 0
                if cnt > 0 and ((max_t and cnt >= max_t) or size + b > max_b):
                    shard, cnt, size = shard + 1, 0, 0
                assert got[(m, p)] == shard, (max_t, max_b, m, p)
                cnt, size = cnt + 1, size + b


def test_model_digest_has_levels_until_one_is_left(spark):
    import hashlib
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(m, p, f"d{m}-{p}") for m, n in ((1, 1), (2, 3), (3, 4), (4, 30)) for p in range(n)] + [(5, 0, "a"), (5, 20, "b")]

    def tree(digests):
        while True:
            groups = {}
            for p, d in sorted(digests.items()):
                groups.setdefault(p // 3, []).append(d)
            top = max(digests)
            digests = {p: sha("".join(v)) for p, v in groups.items()}
            if top // 3 == 0:
                return digests[0]

    got = {r.model: r.model_sha256 for r in C.model_digest(spark.createDataFrame(rows, "model long, pos long, sha256 string"), "model", "pos", fan=3).collect()}
    assert got == {m: tree({p: d for mm, p, d in rows if mm == m}) for m in range(1, 6)}
    assert C.model_digest(spark.createDataFrame([], "model long, pos long, sha256 string"), "model", "pos").count() == 0


def test_plan_shards_small_first(spark):
    rows = [(7, p, b) for p, b in enumerate([5, 5, 1, 9, 2, 2, 2, 2, 10, 1])]
    df = spark.createDataFrame(rows, "model long, pos long, nbytes long")
    got = sorted((r.pos, r.shard) for r in C.plan_shards(df, "model", "pos", "nbytes", 3, 10, small_first=True).collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 3), (7, 4), (8, 5), (9, 6)]


def test_sizes_are_exact_above_2_53(spark):
    df = spark.createDataFrame([([3002399751580331, 3], "F32"), ([3, 3002399751580331], "F32")], "shape array<bigint>, dtype string")
    got = [tuple(r) for r in df.select(C.n_bytes(F.col("shape"), F.col("dtype")), C.pad_to(F.element_at("shape", 1) * 3 + 1, 32)).collect()]
    assert got[0] == (36028797018963972, (3002399751580331 * 3 + 1 + 31) // 32 * 32) and got[1][0] == 36028797018963972


def test_lora_half_pairs_with_the_last_seen_one(spark):
    rows = [(1, 0, "x.lora_a", [4, 8]), (1, 1, "norm", [5]), (1, 2, "x.lora_b", [16, 4]), (2, 0, "x.lora_a", [4, 8]), (2, 1, "y.lora_a", [4, 8]),
            (2, 2, "x.lora_b", [16, 4]), (3, 0, "x.lora_b", [16, 4])]
    df = spark.createDataFrame(rows, "model int, pos int, name string, shape array<bigint>")
    got = {r.model: (r.total_params, r.shared_params) for r in C.parameter_count(df).collect()}
    assert got == {1: (-133, 133), 2: (0, 0), 3: (0, 0)}


def test_merge_metadata_rules(spark):
    s = "e int, key string, value string"
    base = spark.createDataFrame([(1, "a", "old"), (1, "b", "old"), (1, "c", "old"), (1, "GGUF.version", "3"), (1, "general.architecture", "x"),
                                  (1, "tokenizer.chat_template", "t"), (1, "tokenizer.chat_template.tool", "t"), (2, "tokenizer.chat_template.tool", "t")], s)
    new = spark.createDataFrame([(1, "a", "new"), (1, "b", None), (1, "tokenizer.chat_template", "n")], s)
    removed = spark.createDataFrame([(1, "a"), (1, "c")], "e int, key string")
    got = {(r.e, r.key): (r.value, r.origin) for r in C.merge_metadata(base, new, removed, keys=["e", "key"]).collect()}
    assert got == {(1, "a"): ("new", "added"), (1, "tokenizer.chat_template"): ("n", "added"), (2, "tokenizer.chat_template.tool"): ("t", "kept")}


def test_special_token_takes_only_the_first_match(spark):
    types = spark.createDataFrame([("bos", "<s>"), ("eos", "</s>"), ("pad", "<p>"), ("unk", "?")], "type string, content string")
    added = spark.createDataFrame([("<s>", 99, 0), ("<s>", 1, 1), ("</s>", -1, 0), ("</s>", 2, 1), ("<p>", 3, 0)], "content string, id int, pos int")
    got = {r.type: (r.id, r.invalid) for r in C.resolve_special(types, added, 10).collect()}
    assert got == {"bos": (None, False), "eos": (None, True), "pad": (3, False), "unk": (None, False)}


def test_complete_groups_wait_for_all_projections(spark):
    rows = [(1, w, p, [5]) for w in "abc" for p in (0, 1)] + [(2, "a", 0, [5]), (2, "a", 1, [5]), (2, "b", 0, [5]), (3, "a", 0, [5]), (3, "a", 0, [5])]
    df = spark.createDataFrame(rows, "block int, projection string, part int, shape array<bigint>")
    got = {(r.block, r.projection): (r.complete, r.merged_shape) for r in C.complete_groups(df, 2, "abc").collect()}
    assert all(got[(1, w)] == (True, [2, 5]) for w in "abc")
    assert got[(2, "a")] == (False, None) and got[(2, "b")] == (False, None) and got[(3, "a")] == (False, None)


def test_vocabulary_types_by_look_only_for_added_tokens(spark):
    t = spark.createDataFrame([(0, "<|x|>", 0), (1, "<|y|>", 1), (2, "\u2581z", 1), (3, "<0x0A>", 0)], "id bigint, token string, priority int")
    got = {r.id: (r.token, r.toktype) for r in C.densify_vocab(spark, t, 5).collect()}
    k = C.TOKTYPE
    assert got == {0: ("<|x|>", k["NORMAL"]), 1: ("<|y|>", k["CONTROL"]), 2: (" z", k["USER_DEFINED"]), 3: ("<0x0A>", k["NORMAL"]), 4: ("[PAD4]", k["UNUSED"])}
    assert {r.id: r.toktype for r in C.densify_vocab(spark, t, 5, bytes_by_look=True).collect()}[3] == k["BYTE"]


def test_small_models_are_folded_and_large_ones_jumped(spark, monkeypatch):
    import random
    rng = random.Random(5)
    rows = [(m, p * 3 + 1, rng.choice([None, 0, 3, 7, 12, 40]), f"t{p}") for m in range(12) for p in range(m)]
    df = spark.createDataFrame(rows, "model long, pos long, n_bytes long, name string")

    def fold(max_tensors, max_bytes):
        out, shard, n, used, at = {}, 0, 0, 0, None
        for m, p, b, _ in sorted(rows, key=lambda r: r[:2]):
            if m != at:
                at, shard, n, used = m, 0, 0, 0
            if n and (max_tensors and n >= max_tensors or max_bytes and used + (b or 0) > max_bytes):
                shard, n, used = shard + 1, 0, 0
            n, used = n + 1, used + (b or 0)
            out[m, p] = (b, shard)
        return out
    for limits in ((3, 20), (0, 20), (2, 0)):
        for small in (1024, 5):  # all folded; models of more than five tensors jumped
            monkeypatch.setattr(C, "FOLD", small)
            got = C.plan_shards(df, "model", "pos", "n_bytes", *limits)
            assert got.columns[-1] == "shard" and {(r.model, r.pos): (r.n_bytes, r.shard) for r in got.collect()} == fold(*limits)
    # nothing but small models: one shuffle by model, no doubling rounds
    monkeypatch.setattr(C, "FOLD", 1024)
    monkeypatch.setattr(C, "_jumped_shards", None)
    assert C.plan_shards(df.drop("name"), "model", "pos", "n_bytes", 3, 20).count() == len(rows)


def test_digests_of_small_models_take_one_shuffle(spark, monkeypatch):
    rows = [(m, p, f"{m}-{p}") for m in range(9) for p in range(0, m + 1, 1 + m % 2)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "model long, pos long, sha256 string")
    whole = C.model_digest(df, "model", "pos", fan=2)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r.model: r.model_sha256 for r in whole.collect()}
    monkeypatch.setattr(C, "WHOLE", 0)
    assert got == {r.model: r.model_sha256 for r in C.model_digest(df, "model", "pos", fan=2).collect()} and set(got) == set(range(9))


def test_members_of_many_parts_are_sorted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from tallyframe.plans import catalog as PC
    monkeypatch.setattr(PC, "PARTS_A_TASK", 50, raising=False)
    spark.range(300).selectExpr("id as p_partkey", "int(id % 50) as p_size", "'SMALL' as p_type").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = PC.canonical(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 6
    assert out.where("entity = 7 and canonical = 'embedding_length'").first().value == "7"
