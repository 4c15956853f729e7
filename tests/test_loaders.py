import os
import tempfile

import pytest
from pyspark.sql import functions as F

from taxonspark.plans import report
from taxonspark.sources.tables import brands_from_table, leads_from_table, rule_meta, rules_from_table
from taxonspark.sources.workbooks import iter_xlsx, parse_xlsx, read_workbooks, write_xlsx

HEAD = [["logic", None, "x"], ["f1", "f2", "f3", "f4"]]


def raw(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_idx long, cells array<string>")


def test_rules_by_position_short_and_blank_rows(spark):
    rows = HEAD + [[" 一级 ", "12", "原子", "3.9", "奶茶，茶饮", None, "", " ", "a、b", "c,d"], ["x"], []]
    r = rules_from_table(raw(spark, rows)).orderBy("rule_idx").collect()
    assert len(r) == 3
    assert (r[0]["level1"], r[0]["code"], r[0]["atomic"], r[0]["sequence_no"]) == ("一级", "12", "原子", 3)
    assert r[0]["g1"] == ["奶茶", "茶饮"] and r[0]["g5"] == ["a", "b"] and r[0]["must_not"] == ["c", "d"]
    assert r[1]["level1"] == "x" and r[1]["g1"] == [] and r[2]["atomic"] == ""


def test_rule_meta_padded_to_widest_row(spark):
    rows = HEAD + [["a", "b", "c", "d", "e"]]
    m = rule_meta(raw(spark, rows)).orderBy("col_idx").collect()
    assert [(x["logic"], x["field"]) for x in m] == [("logic", "f1"), ("", "f2"), ("x", "f3"), ("", "f4"), ("", "")]


def test_brands_header_lookup(spark):
    df = spark.createDataFrame([(1, None, " 品牌A ", "k", "cat"), (2, "7", "  ", "k", "cat"), (3, "8", "B", None, None)],
                               "row_idx long, `品牌编码` string, ` 品牌名称 ` string, `品牌关键词（，表示同时包含）` string, `原子品类` string")
    b = brands_from_table(df).orderBy("brand_idx").collect()
    assert [(x["brand_idx"], x["brand_code"], x["brand_name"], x["atomic"]) for x in b] == [(1, "", "品牌A", "cat"), (3, "8", "B", "")]
    missing = spark.createDataFrame([(1, "a")], "row_idx long, `品牌名称` string")
    assert brands_from_table(missing).count() == 0


def test_leads_require_both_columns(spark):
    df = spark.createDataFrame([(0, " c1 ", " n1 "), (1, "c2", "  "), (2, "", "n1")], "row_idx long, `线索编码` string, `线索名称` string")
    assert [tuple(r) for r in leads_from_table(df).orderBy("lead_idx").collect()] == [(0, "c1", "n1"), (2, "", "n1")]
    with pytest.raises(ValueError):
        leads_from_table(df.drop("线索编码"))


def test_category_nodes(spark):
    df = spark.createDataFrame([(" 1 ", " 餐饮 ", None, None), ("2", "x", -1, "1")], "id string, name string, level int, parent_id string")
    got = [tuple(r) for r in report.category_nodes(df).collect()]
    assert got == [("1", "餐饮", 1, "", True), ("2", "x", -1, "1", False)]


def test_workbook_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="wb-", dir="/tmp")
    write_xlsx([["线索编码", "线索名称"], ["L1", "奶茶店"], [None, None], [12, "  咖啡 "]], os.path.join(d, "a.xlsx"))
    rows = read_workbooks(spark, os.path.join(d, "*.xlsx")).orderBy("row_idx").collect()
    assert [r["cells"] for r in rows] == [["线索编码", "线索名称"], ["L1", "奶茶店"], [None, None], ["12", "  咖啡 "]]
    from taxonspark.sources.tables import header_table
    leads = leads_from_table(header_table(read_workbooks(spark, os.path.join(d, "*.xlsx"))))
    assert [tuple(r) for r in leads.orderBy("lead_idx").collect()] == [(1, "L1", "奶茶店"), (3, "12", "咖啡")]


def test_output_name():
    assert report.output_name("in", "20260101") == "in_匹配结果_20260101"
    assert report.output_name("", "t") == "匹配结果_t"
    assert report.output_name("新建文本文档", "t", "新建文本文档") == "匹配结果_t"


def test_job_from_workbooks(spark):
    from taxonspark.plans.job import load_inputs, result_view, run_job
    d = tempfile.mkdtemp(prefix="wbjob-", dir="/tmp")
    write_xlsx([["判断逻辑"], ["一级原子品类", "品类编码", "原子品类", "序号", "关键词组1"],
                ["饮品", 12, "奶茶店", 1, "奶茶，店"], [None]], os.path.join(d, "rules.xlsx"))
    write_xlsx([["品牌编码", "品牌名称", "品牌关键词（，表示同时包含）", "原子品类"], ["B1", "品牌甲", "", "咖啡"]],
               os.path.join(d, "brands.xlsx"))
    write_xlsx([["线索编码", "线索名称"], ["L1", "奶茶店"], ["L2", "品牌甲"], ["L3", " "], ["L4", "奶茶店"]],
               os.path.join(d, "leads.xlsx"))
    leads, rules, brands = load_inputs(spark, os.path.join(d, "leads.xlsx"), os.path.join(d, "rules.xlsx"),
                                       os.path.join(d, "brands.xlsx"))
    from taxonspark.operators.encode import hashed_ngrams
    out = os.path.join(d, "out")
    assert run_job(spark, leads, rules, brands, out, encoder=hashed_ngrams()) == {"success": 3, "failed": 0, "total": 3}
    got = [(r["线索编码"], r["匹配方式"], r["原子品类"], r["品类编码"]) for r in result_view(spark, out).collect()]
    assert got == [("L1", "规则", "奶茶店", "12"), ("L2", "相似度", "咖啡", ""), ("L4", "规则", "奶茶店", "12")]
    # without an encoder there are no vectors: an exact name scores 0.5 and falls below the gate
    out2 = os.path.join(d, "out2")
    assert run_job(spark, leads, rules, brands, out2)["failed"] == 1
    _, _, none = load_inputs(spark, os.path.join(d, "leads.xlsx"), os.path.join(d, "rules.xlsx"),
                             os.path.join(d, "missing.xlsx"))
    assert none is None
    with pytest.raises(Exception):
        load_inputs(spark, os.path.join(d, "leads.xlsx"), os.path.join(d, "missing_rules.xlsx"), None)


def test_append_results_chunks(spark):
    d = tempfile.mkdtemp(prefix="append-", dir="/tmp") + "/out"
    df = spark.createDataFrame([(i, f"c{i}", "规则") for i in range(10)], "lead_idx long, lead_code string, method string")
    report.append_results(df.where("lead_idx < 5"), d)
    report.append_results(df.where("lead_idx >= 5"), d)
    report.append_results(df.where("lead_idx > 100"), d)  # an empty chunk adds no rows
    back = spark.read.parquet(d)
    assert back.count() == 10 and sorted(r["lead_idx"] for r in back.collect()) == list(range(10))


def _sheet(body: str, styles: str | None = None, props: str = "") -> bytes:
    """A workbook with the given sheet data, and styles if any."""
    import io
    import zipfile
    path = tempfile.mkdtemp(prefix="xlsx-", dir="/tmp") + "/a.xlsx"
    write_xlsx([["x"]], path)
    buf = io.BytesIO()
    with zipfile.ZipFile(path) as src, zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as out:
        for name in src.namelist():
            data = src.read(name).decode()
            if name.endswith("sheet1.xml"):
                data = data[:data.index("<sheetData>")] + f"<sheetData>{body}</sheetData></worksheet>"
            if name.endswith("styles.xml") and styles is not None:
                data = styles
            out.writestr(name, data.replace("<sheets>", props + "<sheets>") if name == "xl/workbook.xml" else data)
    return buf.getvalue()


def test_stray_far_cell_takes_little_memory(spark):
    import tracemalloc
    data = _sheet('<row r="1"><c r="A1"><v>1</v></c><c r="C1"><v>2</v></c></row><row r="1048576"><c r="XFD1048576"><v>7</v></c></row>')
    tracemalloc.start()
    n = 0
    for n, row in enumerate(iter_xlsx(data), 1):  # noqa: B007
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1048576 and len(row) == 16384 and row[-1] == "7" and set(row[:-1]) == {None} and peak < 20e6
    d = tempfile.mkdtemp(prefix="xlsx-", dir="/tmp")
    with open(f"{d}/far.xlsx", "wb") as f:
        f.write(data)
    got = read_workbooks(spark, f"{d}/*.xlsx").selectExpr("count(*) n", "max(row_idx) r", "max(size(cells)) w", "count(error) e").first()
    assert tuple(got) == (1048576, 1048575, 16384, 0)


def test_dates_times_and_durations():
    fmts = ['yyyy"年"m"月"', "[Red]0.00", "[h]:mm", "@", '"day" 0', "\\d0", "[$-409]mmm d"]
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    esc = lambda x: x.replace('"', "&quot;")
    styles = (f'<styleSheet xmlns="{m}"><numFmts>' + "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{esc(f)}"/>' for i, f in enumerate(fmts))
              + '</numFmts><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 22, 46, *range(164, 164 + len(fmts)))) + "</cellXfs></styleSheet>")
    cells = [(1, 43831), (2, 43831.75), (1, 0.5), (3, 1.25), (4, 43831), (5, 43831), (6, 0.0625), (7, 5), (8, 6), (9, 7), (10, 60), (1, 59), (1, 1e9), (0, 43831.5)]
    body = "<row>" + "".join(f'<c s="{s}"><v>{v}</v></c>' for s, v in cells) + '<c t="d"><v>2020-01-01T06:00:00</v></c><c s="1" t="str"><v>5</v></c></row>'
    want = ["2020-01-01 00:00:00", "2020-01-01 18:00:00", "12:00:00", "1 day, 6:00:00", "2020-01-01 00:00:00", "43831", "1:30:00", "5", "6", "7",
            "1900-02-28 00:00:00", "1900-02-28 00:00:00", "#VALUE!", "43831.5", "2020-01-01 06:00:00", "5"]
    assert parse_xlsx(_sheet(body, styles)) == [want]
    later = parse_xlsx(_sheet(body, styles, '<workbookPr date1904="1"/>'))[0]
    assert later[:2] == ["2024-01-02 00:00:00", "2024-01-02 18:00:00"] and later[10] == "1904-03-01 00:00:00"
