import pytest

from taxonspark.operators.rules import RULE_SCHEMA
from taxonspark.params import EMPTY_DESCRIPTION, Params
from taxonspark.plans import report
from taxonspark.plans.cascade import cascade

from test_rules import rule

BRAND_COLS = "brand_idx long, brand_code string, brand_name string, brand_keywords string, atomic string, embedding array<float>"
LEAD_COLS = "lead_idx long, lead_code string, lead_name string, embedding array<float>"
E1, E2 = [1.0, 0.0], [0.0, 1.0]


@pytest.fixture(scope="module")
def inputs(spark):
    rules = spark.createDataFrame([rule(0, g1=["奶茶"], level1="饮品", atomic="奶茶店")], RULE_SCHEMA)
    brands = spark.createDataFrame([(10, " B10 ", "品牌甲", "", " 咖啡 ", E1), (11, "B11", "路边摊", "", "小吃", E2),
                                    (12, "B12", "  ", "", "空名", E1)], BRAND_COLS)
    leads = spark.createDataFrame([
        (0, "c0", " 奶茶店 ", E2),          # rule
        (1, "c1", "品牌甲", E1),            # exact brand hit -> similarity
        (2, "c2", "无描述", E2),            # below gate, no description
        (3, "c3", "搜不到", E2),            # description is an alias
        (4, "c4", "再匹配", E2),            # description matches a rule
        (5, "c5", "描述不中", E2),          # description matches nothing
        (6, "c6", "品牌甲", E1),            # duplicate of 1
    ], LEAD_COLS)
    desc = spark.createDataFrame([("搜不到", " 未匹配到 "), ("再匹配", "一家奶茶饮品店"), ("描述不中", "五金"),
                                  ("无描述", "  ")], "text string, description string")
    return rules, brands, leads, desc


def rows(df):
    return {r["lead_idx"]: r.asDict() for r in df.collect()}


def test_decision_table(inputs):
    rules, brands, leads, desc = inputs
    out = rows(cascade(leads, rules, brands, descriptions=desc))
    assert len(out) == 7
    assert out[0]["lead_name"] == " 奶茶店 " and out[1]["lead_name"] == "品牌甲"  # original names come back
    r = out[0]
    assert (r["level1"], r["code"], r["atomic"], r["method"], r["sim_brand"], r["sim_score"], r["llm_desc"]) == \
        ("饮品", "100", "奶茶店", "规则", "", "", "")
    r = out[1]
    assert (r["level1"], r["code"], r["atomic"], r["method"], r["sim_brand"], r["sim_code"], r["sim_atomic"], r["sim_score"]) == \
        ("", "", "咖啡", "相似度", "品牌甲", " B10 ", "咖啡", "1.0000")
    assert out[6]["method"] == "相似度" and out[6]["lead_code"] == "c6"
    r = out[2]
    assert (r["atomic"], r["method"], r["sim_brand"], r["llm_desc"]) == ("", "搜索后未匹配", "路边摊", EMPTY_DESCRIPTION)
    assert r["sim_score"] != ""
    r = out[3]
    assert (r["atomic"], r["method"], r["sim_brand"], r["llm_desc"]) == ("", "未搜索到", "路边摊", "未匹配到结果")
    r = out[4]
    assert (r["level1"], r["atomic"], r["method"], r["sim_brand"], r["sim_score"], r["llm_desc"]) == \
        ("饮品", "奶茶店", "搜索后匹配", "", "", "一家奶茶饮品店")
    r = out[5]
    assert (r["atomic"], r["method"], r["sim_brand"], r["llm_desc"]) == ("", "搜索后未匹配", "路边摊", "五金")


def test_no_brands_and_threshold(inputs, spark):
    rules, brands, leads, desc = inputs
    none = rows(cascade(leads, rules, None))
    assert none[1]["method"] == "未匹配" and none[0]["method"] == "规则"
    empty = spark.createDataFrame([], BRAND_COLS)
    assert rows(cascade(leads, rules, empty))[2]["method"] == "未匹配"
    strict = rows(cascade(leads, rules, brands, descriptions=desc, params=Params(similarity_threshold=0.99)))
    assert strict[2]["method"] == "未匹配" and strict[1]["method"] == "相似度"
    assert all(v == "" for k, v in strict[2].items() if k not in ("lead_idx", "lead_code", "lead_name", "method", "score"))


def test_custom_marker_not_in_aliases(inputs):
    rules, brands, leads, desc = inputs
    out = rows(cascade(leads, rules, brands, descriptions=desc, params=Params(unmatched_marker="查无")))
    assert out[3]["method"] == "搜索后未匹配" and out[3]["llm_desc"] == "查无"


def test_provider_callable(inputs):
    rules, brands, leads, _ = inputs

    def provider(text):
        if text == "无描述":
            raise RuntimeError("service down")  # a failed call counts as no description
        return {"再匹配": "奶茶"}.get(text)

    out = rows(cascade(leads, rules, brands, provider=provider))
    assert out[4]["method"] == "搜索后匹配" and out[2]["llm_desc"] == EMPTY_DESCRIPTION
    assert rows(cascade(leads, rules, brands, provider=provider, params=Params(provider_tasks=2))) == out


def test_reports(inputs):
    rules, brands, leads, desc = inputs
    out = cascade(leads, rules, brands, descriptions=desc)
    c = report.match_counts(out).first()
    assert (c["n_success"], c["n_failed"], c["n_total"]) == (4, 3, 7)
    prog = report.chunk_progress(out, 3).orderBy("chunk").collect()
    assert [(p["processed"], p["percent"]) for p in prog] == [(3, 42.9), (6, 85.7), (7, 100.0)]
    flags = {r["lead_idx"]: r["is_failed"] for r in report.flag_failed(out).collect()}
    assert flags[0] is False and flags[2] is True


def test_flagship_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "method" in df.columns


def test_stream_equals_batch(spark):
    from taxonspark.plans.catalog import q_cascade_full
    from taxonspark.streaming.chunked import q_stream_chunked
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in q_stream_chunked(spark, sf).select(*q_cascade_full(spark, sf).columns).collect())
    b = sorted(tuple(r) for r in q_cascade_full(spark, sf).collect())
    assert a == b


def test_batch_job_writes_ordered_results(inputs, spark):
    import tempfile
    from taxonspark.plans.job import result_view, run_job
    rules, brands, leads, desc = inputs
    out = tempfile.mkdtemp(prefix="job-", dir="/tmp") + "/out"
    counts = run_job(spark, leads, rules, brands, out, descriptions=desc)
    assert counts == {"success": 4, "failed": 3, "total": 7}
    view = result_view(spark, out).collect()
    assert [r["lead_idx"] for r in view] == list(range(7)) and "匹配方式" in view[0].asDict()


def test_wrong_dimension_vectors_become_error_rows(spark):
    from taxonspark.plans.catalog import q_error_rows
    out = q_error_rows(spark, "/root/testdata/sf0.001").groupBy("method").count().collect()
    counts = {r["method"]: r["count"] for r in out}
    assert counts.get("程序异常", 0) > 0 and counts.get("规则", 0) > 0
    err = q_error_rows(spark, "/root/testdata/sf0.001").where("method = '程序异常'").first()
    assert (err["atomic"], err["sim_brand"], err["sim_score"], err["llm_desc"]) == ("", "", "", "程序异常")


def test_brand_dimension_mismatch_fails_scored_rows_only(inputs, spark):
    rules, _, leads, desc = inputs
    brands = spark.createDataFrame([(10, "B10", "品牌甲", "", "咖啡", [1.0, 0.0]), (11, "B11", "路边摊", "", "小吃", [1.0])],
                                   BRAND_COLS)
    out = rows(cascade(leads, rules, brands, descriptions=desc))
    assert out[0]["method"] == "规则"
    assert all(out[i]["method"] == "程序异常" for i in (1, 2, 3, 4, 5, 6))


def test_score_equal_to_gate_is_similarity(inputs, spark):
    from taxonspark.operators.similarity import top1
    rules, brands, leads, desc = inputs
    one = leads.where("lead_idx = 2")
    score = top1(one.withColumn("_t", one.lead_name), brands, ["lead_idx"], "_t", "embedding").first()["score"]
    at_gate = rows(cascade(one, rules, brands, descriptions=desc, params=Params(fallback_threshold=score)))
    above = rows(cascade(one, rules, brands, descriptions=desc, params=Params(fallback_threshold=score + 1e-12)))
    assert at_gate[2]["method"] == "相似度" and above[2]["method"] == "搜索后未匹配"


def test_nan_score_never_wins(spark):
    from taxonspark.operators.similarity import top1
    nan = float("nan")
    texts = spark.createDataFrame([(1, "abc", [1.0, 0.0])], "k long, t string, v array<float>")
    brands = spark.createDataFrame([(0, "0", "abc", "", "x", [nan, 0.0]), (1, "1", "zzz", "", "y", [0.0, 1.0])], BRAND_COLS)
    assert top1(texts, brands, ["k"], "t", "v").first()["brand_idx"] == 1
    only_nan = spark.createDataFrame([(0, "0", "abc", "", "x", [nan, 0.0])], BRAND_COLS)
    assert top1(texts, only_nan, ["k"], "t", "v").first()["brand_idx"] is None


def test_encoder_fills_text_and_brand_vectors(spark):
    from taxonspark.operators.encode import hashed_ngrams
    rules = spark.createDataFrame([rule(0, g1=["奶茶"])], RULE_SCHEMA)
    brands = spark.createDataFrame([(10, "B10", "品牌甲", "", "咖啡", None), (11, "B11", "路边摊", "", "小吃", None)], BRAND_COLS)
    leads = spark.createDataFrame([(0, "c0", "品牌甲", None), (1, "c1", "路边摊", None), (2, "c2", "奶茶", None)], LEAD_COLS)
    out = rows(cascade(leads, rules, brands, encoder=hashed_ngrams(32)))
    assert (out[0]["method"], out[0]["sim_brand"], out[0]["sim_score"]) == ("相似度", "品牌甲", "1.0000")
    assert (out[1]["method"], out[1]["sim_brand"]) == ("相似度", "路边摊")
    assert out[2]["method"] == "规则"


def test_blank_text_is_unmatched(inputs, spark):
    rules, brands, _, desc = inputs
    leads = spark.createDataFrame([(0, "c0", "　 ", E1), (1, "c1", "", None)], LEAD_COLS)
    out = rows(cascade(leads, rules, brands, descriptions=desc))
    assert out[0]["method"] == "未匹配" and out[1]["method"] == "未匹配" and out[0]["sim_brand"] == ""


def test_cascade_same_under_anchor_plan(inputs):
    rules, brands, leads, desc = inputs
    a = rows(cascade(leads, rules, brands, descriptions=desc))
    b = rows(cascade(leads, rules, brands, descriptions=desc, params=Params(rule_plan="anchor")))
    assert a == b


def test_repeated_description_rows_do_not_multiply_results(inputs, spark):
    rules, brands, leads, desc = inputs
    twice = desc.unionByName(desc).unionByName(spark.createDataFrame([("描述不中", None)], "text string, description string"))
    assert rows(cascade(leads, rules, brands, descriptions=twice)) == rows(cascade(leads, rules, brands, descriptions=desc))


def test_long_texts_are_joined_by_their_digest(spark):
    """A long text is no join key: it travels to the kernel only."""
    from taxonspark.functions.text import text_key
    from taxonspark.plans.cascade import distinct_texts, per_text_results, reattach
    long = "a red thing of many words " * 9
    digest = spark.createDataFrame([(long,)], "t string").select(text_key("t")).first()[0]
    names = [long, f"  {long}", long + "!", "short", " short ", None, "", digest, digest[1:]]
    leads = spark.createDataFrame([(i, str(i), n, None) for i, n in enumerate(names)], LEAD_COLS)
    brands = spark.createDataFrame([(1, "b1", "red thing", "", "X", None), (2, "b2", "short", "", "Y", None)], BRAND_COLS)
    descriptions = spark.createDataFrame([(long.strip(), "told"), (digest, "digest")], "text string, description string")
    none = spark.createDataFrame([], RULE_SCHEMA)
    out = {r.lead_idx: r for r in cascade(leads, none, brands, descriptions).collect()}
    assert [out[i].lead_name for i in range(len(names))] == names and len(out) == len(names)
    assert [out[i].llm_desc for i in (0, 1, 7)] == ["told", "told", "digest"] and out[2].llm_desc != "told" != out[8].llm_desc
    assert out[3].sim_brand == out[4].sim_brand == "short"
    per_text = per_text_results(distinct_texts(leads), none, brands, descriptions)
    assert reattach(leads, per_text).count() == len(names)
    plan = cascade(leads, none, brands, descriptions).select("lead_idx", "method")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan
