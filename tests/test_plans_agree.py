"""Plans that must give the same rows: describer and encoder calls, repeated keys, null names, chunks, files."""

import os
import tempfile

import numpy as np
import pytest

from taxonspark.functions.similarity import encode_names, jaro_winkler, jaro_winkler_many, jaro_winkler_pairs
from taxonspark.operators.describe import ANSWER, describe
from taxonspark.operators.rules import RULE_SCHEMA
from taxonspark.operators.similarity import prepare_brands, top1
from taxonspark.params import Params
from taxonspark.plans.cascade import RESULT_SCHEMA, cascade
from taxonspark.plans.committed import CommittedSink, success_counts
from taxonspark.plans.job import run_files
from taxonspark.sources.tables import brands_from_workbooks, dense_position, leads_from_workbooks, workbook_errors
from taxonspark.sources.workbooks import read_workbooks, write_workbooks, write_xlsx
from taxonspark.streaming.chunked import progress, results_so_far, run_chunked, stage_leads

from test_cascade import BRAND_COLS, E1, E2, LEAD_COLS, rows
from test_rules import rule

PLANS = ["literal", "anchor", "auto"]


@pytest.fixture(scope="module")
def calls():
    """A folder in which every describer or encoder call leaves a file (calls run in Python workers)."""
    return tempfile.mkdtemp(prefix="calls-", dir="/tmp")


def counter(folder):
    def counted(text):  # nested, so that it is sent to the workers by value
        fd, _ = tempfile.mkstemp(prefix="call-", dir=folder)
        os.write(fd, text.encode())
        os.close(fd)
    return counted


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("tasks", [0, 2])
def test_each_active_text_is_described_once(spark, calls, plan, tasks):
    folder = tempfile.mkdtemp(dir=calls)
    rules = spark.createDataFrame([rule(0, g1=["decided"]), rule(1, g1=["described"], atomic="D")], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B", "brand", "", "x", None)], BRAND_COLS)
    leads = spark.createDataFrame([(i, f"c{i}", f"text {i % 20}" if i % 2 else f"decided {i}", None) for i in range(60)], LEAD_COLS)

    counted = counter(folder)

    def provider(text):  # another answer on every call: a second call would show
        counted(text)
        return f"described {os.urandom(4).hex()}"

    out = rows(cascade(leads, rules, brands, provider=provider, params=Params(rule_plan=plan, provider_tasks=tasks)))
    asked = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert asked == sorted(f"text {k}" for k in range(20) if k % 2)
    assert {r["method"] for i, r in out.items() if i % 2} == {"搜索后匹配"} and {r["atomic"] for i, r in out.items() if i % 2} == {"D"}


@pytest.mark.parametrize("grid", [False, True])
def test_each_text_is_encoded_once(spark, calls, grid):
    folder = tempfile.mkdtemp(dir=calls)

    counted = counter(folder)

    def encoder(texts):
        for t in texts:
            counted(t)
        return np.array([[len(t), 1.0] for t in texts])

    rules = spark.createDataFrame([rule(0, g1=["decided"])], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B1", "brand", "", "x", None), (2, "B2", "vectored", "", "y", E1)], BRAND_COLS)
    leads = spark.createDataFrame([(i, f"c{i}", f"text {i % 15}" if i % 2 else "decided", None) for i in range(60)], LEAD_COLS)
    params = Params(max_broadcast_brands=0, grid_blocks=2, grid_buckets=3) if grid else Params()
    out = cascade(leads, rules, brands, params=params, encoder=encoder).collect()
    assert len(out) == 60
    asked = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert asked == sorted([f"text {k}" for k in range(15)] + ["brand"])  # the brand with a vector keeps it


def test_brands_without_vector_are_filled_and_weight_is_kept(spark):
    rules = spark.createDataFrame([rule(0, g1=["zzz"])], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B1", "abc", "", "x", None), (2, "B2", "xyz", "", "y", E2)], BRAND_COLS)
    leads = spark.createDataFrame([(0, "c", "abd", E1)], LEAD_COLS)
    r = rows(cascade(leads, rules, brands, params=Params(vector_weight=0.8), encoder=lambda ts: np.array([E1 for _ in ts])))[0]
    assert r["sim_brand"] == "abc" and abs(r["score"] - (0.8 + 0.2 * jaro_winkler("abd", "abc"))) < 1e-12


def test_grid_and_broadcast_agree_on_repeated_keys(spark):
    brands = spark.createDataFrame([(i, f"B{i}", f"name {i}", "", "x", E1 if i % 2 else E2) for i in range(9)], BRAND_COLS)
    texts = spark.createDataFrame([(1, "name 3", E1)] * 3 + [(2, "", E1), (2, None, E1), (3, "name 8", None)], "k long, t string, v array<float>")
    got = [sorted(map(str, top1(texts, brands, "k", "t", "v", p, plan).collect()))
           for plan, p in (("broadcast", Params()), ("grid", Params(grid_blocks=2, grid_buckets=2)))]
    assert got[0] == got[1] and len(got[0]) == 6


def test_leads_without_a_name_keep_their_rows(spark):
    rules = spark.createDataFrame([rule(0, g1=["a"])], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B1", "abc", "", "x", E1)], BRAND_COLS)
    leads = spark.createDataFrame([(0, "c0", "a", E1), (1, "c1", None, E1), (2, "c2", None, None), (3, "c3", " ", E2)], LEAD_COLS)
    for plan in PLANS:
        out = rows(cascade(leads, rules, brands, params=Params(rule_plan=plan)))
        assert sorted(out) == [0, 1, 2, 3] and [out[i]["method"] for i in range(4)] == ["规则", "未匹配", "未匹配", "未匹配"]
        assert out[1]["lead_name"] is None


def test_one_bad_row_is_one_error_row(spark, monkeypatch):
    brands = spark.createDataFrame([(1, "B1", "abc", "", "x", E1)], BRAND_COLS)
    texts = spark.createDataFrame([(i, f"t{i}", [1.0, float(i)]) for i in range(5)] + [(9, "t9", [1.0])], "k long, t string, v array<float>")
    got = {r.k: r for r in top1(texts, brands, "k", "t", "v").collect()}
    assert [k for k, r in got.items() if r.error] == [9] and all(got[k].brand_idx == 1 for k in range(5))


def test_size_check_counts_names_and_vectors(spark):
    brands = spark.createDataFrame([(i, "", "n" * 1000, "", "", E1) for i in range(20)], BRAND_COLS)
    assert prepare_brands(brands, Params(max_broadcast_bytes=20 * 5000)) is None
    assert prepare_brands(brands, Params()) is not None


def test_jaro_winkler_forms_agree():
    rng = np.random.default_rng(2)
    abc = list("abcdé奶茶 ")
    texts = ["".join(rng.choice(abc, rng.integers(0, 14))) for _ in range(300)] + [None, " ", "a" * 60, "martha", "marhta"]
    other = ["".join(rng.choice(abc, rng.integers(0, 20))) for _ in range(300)] + ["x", "y", "a" * 61, "marhta", None]
    want = [jaro_winkler(a, b) for a, b in zip(texts, other)]
    assert jaro_winkler_pairs(texts, other).tolist() == want
    mat, lens = encode_names([x or "" for x in other])
    long = "".join(rng.choice(abc, 30_000))
    for a in [*texts[:40], long]:
        assert jaro_winkler_many(a, mat, lens).tolist() == [jaro_winkler(a, b) for b in other]
    assert jaro_winkler_pairs([long], ["abc"]).tolist() == [jaro_winkler(long, "abc")]


def test_dense_position(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(0, 101, 2)], "k long").repartition(5)
    got = sorted((r.pos, r.k) for r in dense_position(df, ["k"], "pos").collect())
    assert [p for p, _ in got] == list(range(51)) and [k for _, k in got] == sorted(k for _, k in got)
    assert dense_position(df.limit(0), ["k"], "pos").count() == 0


def test_workbooks_keep_their_own_headers(spark):
    d = tempfile.mkdtemp(prefix="wbs-", dir="/tmp")
    write_xlsx([["线索编码", "线索名称", "线索名称"], ["c1", "red a", "x"], ["c2", None, "y"], ["c3", "red b", "z"]], os.path.join(d, "a.xlsx"))
    write_xlsx([[" 线索名称", "线索编码"], ["blue", "c4"]], os.path.join(d, "b.xlsx"))
    write_xlsx([["线索名称"], ["no code"]], os.path.join(d, "c.xlsx"))
    with open(os.path.join(d, "d.xlsx"), "wb") as f:
        f.write(b"not a workbook")
    raw = read_workbooks(spark, os.path.join(d, "*.xlsx"))
    leads = leads_from_workbooks(raw)
    assert [(r.path[-6:], r.lead_idx, r.lead_code, r.lead_name) for r in leads.orderBy("lead_idx").collect()] == [
        ("a.xlsx", 0, "c1", "red a"), ("a.xlsx", 1, "c3", "red b"), ("b.xlsx", 2, "c4", "blue")]
    errors = {r.path[-6:]: r.error for r in workbook_errors(raw).collect()}
    assert set(errors) == {"c.xlsx", "d.xlsx"} and "线索编码" in errors["c.xlsx"]
    rules = spark.createDataFrame([rule(0, g1=["red"])], RULE_SCHEMA)
    out = run_files(spark, leads, rules, None, os.path.join(d, "out"), "20260101", ignore="b")
    assert {(r.path[-6:], r.output, r.n_rows, r.n_success) for r in out.collect()} == {
        ("a.xlsx", "a_匹配结果_20260101", 2, 2), ("b.xlsx", "匹配结果_20260101", 1, 0)}
    assert sorted(x for x in os.listdir(os.path.join(d, "out")) if x.startswith("output=")) == ["output=a_匹配结果_20260101", "output=匹配结果_20260101"]


def test_brand_workbooks(spark):
    d = tempfile.mkdtemp(prefix="wbb-", dir="/tmp")
    write_xlsx([["品牌名称", "原子品类"], ["n1", "a1"], [" ", "a2"]], os.path.join(d, "a.xlsx"))
    write_xlsx([["原子品类", "品牌编码", "品牌名称"], ["a3", 7, "n3"]], os.path.join(d, "b.xlsx"))
    got = brands_from_workbooks(read_workbooks(spark, os.path.join(d, "*.xlsx"))).orderBy("brand_idx").collect()
    assert [(r.brand_idx, r.brand_code, r.brand_name, r.atomic) for r in got] == [(0, "", "n1", "a1"), (1, "7", "n3", "a3")]


def test_workbooks_go_to_posix_paths_only(spark):
    with pytest.raises(ValueError, match="s3a"):
        write_workbooks(spark.range(1), "s3a://bucket/x", ["id"], 1)


def test_phonetic_hints_and_rows_without_number():
    import io
    import zipfile

    from taxonspark.sources.workbooks import parse_xlsx
    d = tempfile.mkdtemp(dir="/tmp")
    write_xlsx([["x"]], os.path.join(d, "a.xlsx"))
    buf = io.BytesIO()
    with zipfile.ZipFile(os.path.join(d, "a.xlsx")) as src, zipfile.ZipFile(buf, "w") as out:
        for name in src.namelist():
            data = src.read(name).decode()
            if name.endswith("sheet1.xml"):
                data = data[:data.index("<sheetData>")] + (
                    '<sheetData><row><c t="inlineStr"><is><r><t>東</t></r><r><t>京</t></r><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></is></c></row>'
                    "<row><c><v>5</v></c></row></sheetData></worksheet>")
            out.writestr(name, data)
    assert parse_xlsx(buf.getvalue()) == [["東京"], ["5"]]


def test_chunked_run_by_rows(spark):
    d = tempfile.mkdtemp(prefix="chunks-", dir="/tmp")
    rules = spark.createDataFrame([rule(0, g1=["a"])], RULE_SCHEMA)
    leads = spark.createDataFrame([(i * 3 + 5, f"c{i}", "a" if i % 5 else "zz", None) for i in range(23)], LEAD_COLS).repartition(4)
    assert stage_leads(leads, f"{d}/in", 10) == 3
    run_chunked(spark, f"{d}/in", f"{d}/out", f"{d}/chk", rules, None)
    assert [tuple(r) for r in progress(spark, f"{d}/out").orderBy("batch_id").collect()] == [(0, 8, 2, 10, 10), (1, 8, 2, 10, 20), (2, 2, 1, 3, 23)]
    out = results_so_far(spark, f"{d}/out", RESULT_SCHEMA)
    assert sorted((r.chunk, r.lead_idx) for r in out.collect()) == [(str(i // 10), i * 3 + 5) for i in range(23)]


def test_one_chunk_takes_several_tasks(spark):
    d = tempfile.mkdtemp(prefix="chunks-", dir="/tmp")
    leads = spark.range(40_000).selectExpr("id as lead_idx", "string(id) as lead_code", "'n' as lead_name").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert stage_leads(leads, f"{d}/in", 0) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(f"{d}/in/rows/chunk=0") if f.endswith(".parquet")]) > 1


def test_texts_are_decided_once_over_all_chunks(spark, calls):
    """A name in every chunk is encoded and described once, also when the run broke between decisions and results."""
    folder, d = tempfile.mkdtemp(dir=calls), tempfile.mkdtemp(prefix="chunks-", dir="/tmp")
    counted = counter(folder)

    def encoder(texts):
        for t in texts:
            counted("e:" + t)
        return np.array([[len(t), 1.0] for t in texts])

    def provider(text):
        counted("p:" + text)
        return "described"

    rules = spark.createDataFrame([rule(0, g1=["decided"]), rule(1, g1=["described"], atomic="D")], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B1", "brand", "", "x", E1)], BRAND_COLS)
    leads = spark.createDataFrame([(i, f"c{i}", f"text {i % 7}" if i % 2 else "decided", None) for i in range(60)], LEAD_COLS)
    stage_leads(leads, f"{d}/in", 20)
    args = dict(provider=provider, encoder=encoder)
    append, broken = CommittedSink.append, []

    def failing(self, df, chunk, counts=None, order=None):
        if not self.path.endswith("_decisions") and str(chunk) == "1" and not broken:
            broken.append(chunk)
            raise OSError("lost")
        return append(self, df, chunk, counts, order)

    CommittedSink.append = failing
    try:
        with pytest.raises(Exception):
            run_chunked(spark, f"{d}/in", f"{d}/out", f"{d}/chk", rules, brands, **args)
    finally:
        CommittedSink.append = append
    assert broken and progress(spark, f"{d}/out").count() == 1
    run_chunked(spark, f"{d}/in", f"{d}/out", f"{d}/chk", rules, brands, **args)
    asked = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert asked == sorted(f"{k}:text {i}" for i in range(7) for k in "ep")
    got = {r.lead_idx: (r.method, r.atomic) for r in results_so_far(spark, f"{d}/out", RESULT_SCHEMA).collect()}
    assert len(got) == 60 and {got[i] for i in range(60) if i % 2} == {("搜索后匹配", "D")} and got[0][0] == "规则"


def test_committed_sink(spark):
    d = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    sink, df = CommittedSink(spark, d), spark.range(10).selectExpr("id as lead_idx", "if(id < 4, '规则', '未匹配') as method")
    assert sink.read(df.schema).count() == 0 and sink.manifests().count() == 0
    first = sink.append(df, 0, success_counts())
    assert (first["n_rows"], first["n_success"], first["n_failed"]) == (10, 4, 6)
    assert sink.append(df, 0) == first  # repeated
    df.write.parquet(f"{d}/rows/chunk=1/attempt=half")  # broken half-way: written, never published
    assert sink.read(df.schema).count() == 10 and sink.published(1) is None
    sink.append(df.limit(0), 2)
    sink._publish({"chunk": "0", "attempt": "late", "n_rows": 99})  # a second attempt that ends later
    assert sink.published(0) == first and sink.read(df.schema).count() == 10
    with pytest.raises(ValueError):
        sink.append(df, "../x")


@pytest.mark.parametrize("grid", [False, True])
def test_a_text_the_encoder_rejects_is_one_error_row(spark, grid):
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no " + next(t for t in texts if "bad" in t))
        return np.array([[len(t), 1.0] for t in texts])

    rules = spark.createDataFrame([rule(0, g1=["decided"])], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B1", "brand", "", "x", None), (2, "B2", "text 3", "", "y", E1)], BRAND_COLS)
    names = [f"text {i}" for i in range(12)] + ["bad 1", "decided bad", "bad 2", "bad 1"]
    leads = spark.createDataFrame([(i, f"c{i}", n, None) for i, n in enumerate(names)], LEAD_COLS)
    params = Params(max_broadcast_brands=0, grid_blocks=2, grid_buckets=3) if grid else Params()
    out = rows(cascade(leads, rules, brands, params=params, encoder=encoder))
    clean = rows(cascade(leads.where("lead_name not like 'bad%'"), rules, brands, params=params, encoder=encoder))
    assert {i: r["method"] for i, r in out.items() if i >= 12} == {12: "程序异常", 13: "规则", 14: "程序异常", 15: "程序异常"}
    assert all(out[i] == clean[i] for i in clean)


def test_answers_survive_a_broken_run(spark, calls):
    """A run that ends between two batches of answers: the next one asks only the texts that were not answered."""
    folder, d = tempfile.mkdtemp(dir=calls), tempfile.mkdtemp(prefix="journal-", dir="/tmp")
    counted = counter(folder)

    def provider(text):
        counted(text)
        return None if text.endswith("7") else f"described {text}"

    rules = spark.createDataFrame([rule(0, g1=["described"], atomic="D")], RULE_SCHEMA)
    brands = spark.createDataFrame([(1, "B", "brand", "", "x", None)], BRAND_COLS)
    leads = spark.createDataFrame([(i, f"c{i}", f"text {i % 30}", E1 if i % 2 else None) for i in range(90)], LEAD_COLS)
    params = Params(provider_batch=7, answer_journal=d)
    append, done = CommittedSink.append, []

    def failing(self, *a, **k):
        if len(done) == 2:
            raise OSError("lost")
        done.append(append(self, *a, **k))
        return done[-1]

    CommittedSink.append = failing
    try:
        with pytest.raises(OSError):
            cascade(leads, rules, brands, provider=provider, params=params)
    finally:
        CommittedSink.append = append
    before = len(os.listdir(folder))
    assert before == sum(m["n_rows"] for m in done) and 0 < before < 30
    out = rows(cascade(leads, rules, brands, provider=provider, params=params))
    asked = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert asked == sorted(f"text {k}" for k in range(30))
    assert {r["method"] for i, r in out.items() if i % 30 % 10 != 7} == {"搜索后匹配"} and len(out) == 90
    assert {r["method"] for i, r in out.items() if i % 30 % 10 == 7} == {"搜索后未匹配"}


def test_failed_calls_are_tried_again_and_not_journaled(spark, calls):
    folder, d = tempfile.mkdtemp(dir=calls), tempfile.mkdtemp(prefix="journal-", dir="/tmp")
    counted = counter(folder)

    def provider(text):
        counted(text)
        if "flaky" in text and sum(open(os.path.join(folder, f)).read() == text for f in os.listdir(folder)) < 3:
            raise TimeoutError
        if "never" in text:
            raise TimeoutError
        return "fine"

    texts = spark.createDataFrame([("flaky",), ("never",), ("good",), ("good",)], "t string")
    params = Params(provider_retries=2, provider_wait=0.01, answer_journal=d)
    got = {r.t: r.description for r in describe(texts, "t", provider=provider, params=params).collect()}
    assert got == {"flaky": "fine", "never": None, "good": "fine"}
    asked = sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert asked == ["flaky"] * 3 + ["good"] + ["never"] * 3
    assert sorted(r.text for r in CommittedSink(spark, d).read(ANSWER).collect()) == ["flaky", "good"]
