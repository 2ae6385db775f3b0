"""J14 rules against the reference's cases, and each rule on its own."""

import json

from tallyframe.operators.metadata import resolve_metadata

SOURCES = ("card", "params", "directory", "generation", "override", "given_name", "remote_id")
MERGE = {"name": "Mistral 7B Merge 14 v0", "organization": "EmbeddedLLM", "version": "14-v0", "repo_url": "https://huggingface.co/EmbeddedLLM/Mistral-7B-Merge-14-v0"}
TRINITY = {"name": "Trinity v1", "organization": "Janai Hq", "version": "v1", "repo_url": "https://huggingface.co/janai-hq/trinity-v1"}
HERMES = {"name": "OpenHermes 2.5", "organization": "Teknium", "version": "2.5", "repo_url": "https://huggingface.co/teknium/OpenHermes-2.5"}
TAGS = ["Llama-3", "instruct", "finetune", "chatml", "DPO", "RLHF", "gpt4", "synthetic data", "distillation", "function calling", "json mode", "axolotl"]
FULL = {"name": "Hermes 2 Pro Llama 3 8b DPO", "finetune": "DPO", "basename": "hermes-2-pro-llama-3", "size_label": "8B"}

# Golden values: sources of one model -> its keys.
CASES = [
    ({"card": {"tags": TAGS, "model-index": [{"name": "x"}], "language": ["en"], "datasets": ["teknium/OpenHermes-2.5"],
               "base_model": ["EmbeddedLLM/Mistral-7B-Merge-14-v0", "janai-hq/trinity-v1"]}},
     {"base_models": [MERGE, TRINITY], "tags": TAGS, "languages": ["en"], "datasets": [HERMES]}),
    ({"card": {"base_models": "teknium/OpenHermes-2.5"}}, {"base_models": [HERMES]}),
    ({"card": {"base_models": ["https://huggingface.co/teknium/OpenHermes-2.5"]}}, {"base_models": [HERMES]}),
    ({"card": {"base_models": [HERMES]}}, {"base_models": [HERMES]}),
    ({"card": {"datasets": "teknium/OpenHermes-2.5"}}, {"datasets": [HERMES]}),
    ({"card": {"datasets": ["https://huggingface.co/teknium/OpenHermes-2.5"]}}, {"datasets": [HERMES]}),
    ({"card": {"datasets": [HERMES]}}, {"datasets": [HERMES]}),
    ({"params": {"_name_or_path": "./hermes-2-pro-llama-3-8b-DPO"}}, FULL),
    ({"directory": "./hermes-2-pro-llama-3-8b-DPO"}, FULL),
    # each rule
    ({"card": {"name": None, "model_name": "a", "model_author": "b", "model_creator": "c", "model_type": "d", "basename": ""}},
     {"name": "a", "author": "b", "basename": ""}),
    ({"card": {"tags": "one", "pipeline_tag": ["two", 3], "languages": 5, "license": "mit", "license_name": 7}},
     {"tags": ["one", "two", "3"], "languages": [], "license": "mit", "license_name": "7"}),
    ({"card": {"base_model": None, "base_models": "x/y", "dataset_sources": 4, "tags": None}}, {"base_models": [], "datasets": []}),
    ({"params": {"_name_or_path": "/home/me/models-7b"}}, {}),
    ({"params": {"_name_or_path": 5}, "directory": "/m/mini-7B-v2/"}, {"name": "Mini 7B v2", "basename": "mini", "version": "v2", "size_label": "7B"}),
    ({"params": {"_name_or_path": "acme/falcon-7B-chat"}, "directory": "/m/other-13B-v3", "card": {"version": "9"}},
     {"name": "Falcon 7B Chat", "organization": "Acme", "basename": "falcon", "finetune": "chat", "size_label": "7B", "version": "9"}),
    ({"generation": {"top_k": 40, "temperature": 0.5, "temp": 1, "min_p": None, "sequence": "a"}}, {"sampling_top_k": 40, "sampling_temp": 0.5, "sampling_sequence": "a"}),
    ({"generation": {"top_k": 40, "top_p": 0.9}, "override": {"general.sampling.top_k": None, "general.sampling.top_p": 0.1}}, {"sampling_top_p": 0.1}),
    ({"card": {"author": "a", "license": "mit", "tags": ["x"]}, "override": {"general.author": None, "general.license": "no", "general.tags": ["y"], "general.url": "u", "author": "z"}},
     {"license": "mit", "tags": ["y"], "url": "u"}),
    ({"card": {"name": "card"}, "override": {"general.name": "over"}, "given_name": "given"}, {"name": "given"}),
    ({"card": {"name": "card"}, "given_name": "given", "remote_id": "org/remote"}, {"name": "org/remote"}),
    ({"directory": "/a/b", "override": {"general.name": None}}, {"name": "b"}),
    ({}, {}),
]


def resolve(spark, sources, **more):
    rows = [(i, *[json.dumps(s[c]) if isinstance(s.get(c), dict) else s.get(c) for c in SOURCES]) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} string" for c in SOURCES))
    out = {i: {} for i in range(len(sources))}
    for r in resolve_metadata(df, "id", **{c: c for c in SOURCES}, **more).collect():
        assert r.key not in out[r.id]
        out[r.id][r.key] = (r.value, r.source)
    return out


def plain(value):
    return value if isinstance(value, str) else json.dumps(value)


def test_cases(spark):
    got = resolve(spark, [s for s, _ in CASES])
    for i, (sources, want) in enumerate(CASES):
        have = {k: v for k, (v, _) in got[i].items()}
        assert set(have) == set(want), sources
        for k, v in want.items():
            assert have[k] == v if isinstance(v, str) else json.loads(have[k]) == v, (sources, k)


def test_documents_that_are_no_objects_and_sources(spark):
    odd = ["", "nope", "[1]", "5", '"s"', "null"]
    rows = [(i, text, text, "/m/mini-7B-v2", None, None) for i, text in enumerate(odd)]
    rows += [(100, '{"author": "a"}', '{"general.version": "3"}', "/m/mini-7B-v2", None, None), (101, None, None, None, 10, "10M"), (102, None, None, None, -5, "5M"), (103, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "id int, card string, over string, dir string, total bigint, label string")
    got = {}
    for r in resolve_metadata(df, "id", card="card", params="card", generation="card", override="over", directory="dir", total_params="total", size_label="label").collect():
        got.setdefault(r.id, {})[r.key] = (r.value, r.source)
    named = {"name": ("Mini 7B v2", "directory"), "basename": ("mini", "directory"), "size_label": ("7B", "directory")}
    assert all(got[i] == named | {"version": ("v2", "directory")} for i in range(len(odd)))
    assert got[100] == named | {"author": ("a", "card"), "version": ("3", "override")}
    assert got[101] == {"size_label": ("10M", "computed")} and 102 not in got and 103 not in got


def test_resolution_is_planned_once(spark):
    df = spark.createDataFrame([(1, '{"name": "a"}', "/m/b-7B")], "id int, card string, dir string")
    plan = resolve_metadata(df, "id", card="card", directory="dir")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000 and "size(" not in plan.split("Generate")[0] and not any(line.lstrip(" :+-").startswith("Filter (") and len(line) > 1000 for line in plan.split("\n"))


def test_models_of_one_split_are_spread_over_tasks(spark, tmp_path):
    from tallyframe.plans import metadata as PM
    from tallyframe.plans.common import spread
    n = 4 * PM.MODELS_A_TASK
    spark.range(n).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "1 as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    models = PM._models(spark, str(tmp_path))
    assert models.rdd.getNumPartitions() == 4 and models.count() == n
    assert spread(spark.range(3), "id", 10).count() == 3
