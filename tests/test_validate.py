"""VAL operators: contract validation and the fallback cascade."""

from pyspark.sql import functions as F

from tallyframe.operators import validate as V

VALID = ('{"intent":"x","slots":{},"steps":[{"step_label":"a","api_call":"b","args":{},"expected_state":{}}],'
         '"sources":["s"],"confidence":0.9}')


def _check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", V.json_fragment(F.col("t")))
    return V.validate_contract(df, "v").collect()


def test_contract_cases(spark):
    rows = _check(spark, [VALID, '{"intent":"invalid"}', '{"intent":"bad"}', "prose " + VALID + " more",
                          VALID.replace('"confidence":0.9', '"confidence":1.5'),
                          VALID.replace('"sources":["s"]', '"sources":[1]'),
                          VALID[:-1] + ',"extra":1}',
                          "not json", "[1,2]"])
    assert rows[0].valid and rows[0].errors == []
    assert not rows[1].valid and len(rows[1].errors) == 4
    assert not rows[2].valid
    assert rows[3].valid                          # fragment inside prose
    assert "confidence above maximum 1" in rows[4].errors
    assert rows[5].errors == ["sources[0] must be a string"]
    assert rows[6].extra_fields == 1 and not rows[6].valid
    assert rows[7].errors == ["not a JSON object"] and rows[8].errors == ["not a JSON object"]


def test_step_errors(spark):
    t = ('{"intent":"x","slots":{},"steps":[5,{"step_label":1,"api_call":"b","args":[],"zz":0}],'
         '"sources":[],"confidence":0}')
    r = _check(spark, [t])[0]
    assert "steps[0]: step is not an object" in r.errors
    assert "steps[1]: step missing expected_state" in r.errors
    assert "steps[1]: step_label must be a string" in r.errors
    assert "steps[1]: args must be an object" in r.errors
    assert "steps[1]: unexpected step fields: zz" in r.errors


def test_fallback_plan_valid_and_failure_invalid(spark):
    df = spark.createDataFrame([(["no json here"], "q1"), (['{"steps":[{"step_label":"k"},7,{}]}'], "q2"), ([], "q3")],
                               "snips array<string>, q string")
    d = df.select(V.fallback_plan(F.col("snips"), F.col("q")).alias("p"), V.failure_plan(F.col("q")).alias("f"))
    d = V.validate_contract(V.validate_contract(d, "p", "p_"), "f", "f_")
    rows = d.select("p_valid", "f_valid", F.size(F.try_variant_get("p", "$.steps", "array<variant>")).alias("n"),
                    F.try_variant_get("p", "$.steps[1].step_label", "string").alias("l2")).collect()
    assert all(r.p_valid for r in rows) and not any(r.f_valid for r in rows)
    assert [r.n for r in rows] == [1, 2, 1]
    assert rows[1].l2 == "fallback_step_3"        # numbering keeps the skipped non-object


def test_cascade(spark):
    low = VALID.replace('"confidence":0.9', '"confidence":0.2')
    rows = [(VALID, None, "remote"), ('{"intent":"bad"}', VALID, "local"), (None, low, "fallback"),
            ("", None, "fallback"), (None, "garbage", "fallback")]
    df = spark.createDataFrame([(r, l, ["s"], "q") for r, l, _ in rows], "r string, l string, s array<string>, q string")
    got = [x.chosen_by for x in V.resolve_cascade(df, "r", "l", "s", "q").collect()]
    assert got == [w for _, _, w in rows]


def test_masks(spark):
    df = spark.createDataFrame([("",), ("short",), ("abcdefghij",)], "s string")
    assert [r.m for r in df.select(V.mask_secret(F.col("s")).alias("m")).collect()] == ["", "***", "abcd***ij"]
    h = spark.createDataFrame([({"Authorization": "Bearer abcdefghijkl", "X": "y"},)], "h map<string,string>")
    m = h.select(V.mask_headers(F.col("h")).alias("m")).first().m
    assert m == {"Authorization": "Bearer abcd***kl", "X": "y"}
