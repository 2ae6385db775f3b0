"""P11 model-id parsing against the reference's golden parses."""

from pyspark.sql import functions as F

from tallyframe.functions.naming import parse_artifact_name

# Golden values: (model id, total params) -> (full, org, basename, finetune, version, size label)
CASES = [
    ("Mistral/Mixtral-8x7B-Instruct-v0.1", 0, ("Mixtral-8x7B-Instruct-v0.1", "Mistral", "Mixtral", "Instruct", "v0.1", "8x7B")),
    ("Mixtral-8x7B-Instruct-v0.1", 0, ("Mixtral-8x7B-Instruct-v0.1", None, "Mixtral", "Instruct", "v0.1", "8x7B")),
    ("Mixtral-8x7B-Instruct", 0, ("Mixtral-8x7B-Instruct", None, "Mixtral", "Instruct", None, "8x7B")),
    ("Mixtral-8x7B-v0.1", 0, ("Mixtral-8x7B-v0.1", None, "Mixtral", None, "v0.1", "8x7B")),
    ("Mixtral-8x7B", 0, ("Mixtral-8x7B", None, "Mixtral", None, None, "8x7B")),
    ("Mixtral-v0.1", 0, ("Mixtral-v0.1", None, "Mixtral", None, "v0.1", None)),
    ("Mixtral", 0, ("Mixtral", None, None, None, None, None)),
    ("NousResearch/Meta-Llama-3-8B", 0, ("Meta-Llama-3-8B", "NousResearch", "Meta-Llama-3", None, None, "8B")),
    ("Qwen1.5-MoE-A2.7B-Chat", 0, ("Qwen1.5-MoE-A2.7B-Chat", None, "Qwen1.5-MoE", "Chat", None, "A2.7B")),
    ("Qwen2-57B-A14B-Instruct", 0, ("Qwen2-57B-A14B-Instruct", None, "Qwen2", "Instruct", None, "57B-A14B")),
    ("microsoft/Phi-3-mini-4k-instruct", 4 * 10**9, ("Phi-3-mini-4k-instruct", "microsoft", "Phi-3", "4k-instruct", None, "mini")),
    ("delphi-suite/stories-llama2-50k", 50 * 10**3, ("stories-llama2-50k", "delphi-suite", "stories-llama2", None, None, "50K")),
    ("DeepSeek-Coder-V2-Lite-Instruct", 0, ("DeepSeek-Coder-V2-Lite-Instruct", None, "DeepSeek-Coder-V2-Lite", "Instruct", None, None)),
    ("crestf411/daybreak-kunoichi-2dpo-7b", 0, ("daybreak-kunoichi-2dpo-7b", "crestf411", "daybreak-kunoichi", "2dpo", None, "7B")),
    ("Qwen2-0.5B-Instruct", 0, ("Qwen2-0.5B-Instruct", None, "Qwen2", "Instruct", None, "0.5B")),
    ("smallcloudai/Refact-1_6B-fim", 0, ("Refact-1_6B-fim", "smallcloudai", "Refact", "fim", None, "1.6B")),
    ("UCLA-AGI/Gemma-2-9B-It-SPPO-Iter3", 0, ("Gemma-2-9B-It-SPPO-Iter3", "UCLA-AGI", "Gemma-2", "It-SPPO", "Iter3", "9B")),
    ("NousResearch/Hermes-2-Theta-Llama-3-8B", 0, ("Hermes-2-Theta-Llama-3-8B", "NousResearch", "Hermes-2-Theta-Llama-3", None, None, "8B")),
    ("SeaLLMs/SeaLLMs-v3-7B-Chat", 0, ("SeaLLMs-v3-7B-Chat", "SeaLLMs", "SeaLLMs-v3", "Chat", None, "7B")),
    ("a model name", 0, ("a model name", None, None, None, None, None)),
]


def test_golden_parses(spark):
    df = spark.createDataFrame([(m, t) for m, t, _ in CASES], "id string, total long")
    got = [tuple(r.x) for r in df.select(parse_artifact_name(F.col("id"), F.col("total")).alias("x")).collect()]
    for (m, _, want), g in zip(CASES, got):
        assert g == want, m


def test_source_refs(spark):
    from tallyframe.functions.naming import source_refs
    docs = ['{"base_model": "Mistral/Mixtral-8x7B-Instruct-v0.1"}',
            '{"base_model": ["https://huggingface.co/org/model-7b-v2", "ssh://host/repo", {"name": "X"}, 5]}',
            '{"license": "mit"}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    rows = df.select(source_refs(F.try_variant_get(F.try_parse_json("j"), "$.base_model", "variant")).alias("r")).collect()
    assert [tuple(x) for x in rows[0].r] == [("Mixtral 8x7B Instruct v0.1", "Mistral", "v0.1",
                                            "https://huggingface.co/Mistral/Mixtral-8x7B-Instruct-v0.1")]
    r1 = [tuple(x) for x in rows[1].r]
    assert r1[0] == ("Model 7b v2", "Org", "v2", "https://huggingface.co/org/model-7b-v2")
    assert r1[1] == (None, None, None, "ssh://host/repo")
    assert r1[2] == ("X", None, None, None) and r1[3] == (None, None, None, None)
    assert rows[2].r is None


def test_title_case_like_python(spark):
    from tallyframe.operators.catalog import title_case_id
    ids = ["Mixtral-8x7B-Instruct-v0.1", "Meta-Llama-3-8B", "hermes-2-pro-llama-3-8b-DPO", "llama3b-x"]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    got = [r.t for r in df.select(title_case_id(F.col("s")).alias("t")).collect()]
    ref = [" ".join(w.title() if w.islower() and not __import__("re").match(r"^(v\d+(?:\.\d+)*|\d.*)$", w) else w
                    for w in i.strip().replace("-", " ").split()) for i in ids]
    assert got == ref
