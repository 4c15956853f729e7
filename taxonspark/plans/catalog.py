"""Registered queries: one per operator of the inventory, each over the driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame``; column names match the oracle SQL in
``plans.oracle``. Scores are rounded to 6 places for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import (cell_text, clean_list, ellipsize, l2_normalize, mask_secret, split_keywords, strip, summary,
                              to_int0, url_origin)
from ..operators.describe import describe, fallback_requests
from ..operators.keywords import keyword_hint, keyword_hint_text, keyword_top_n
from ..operators.rules import literal_rule, match_rules, rule_predicate, rules_left
from ..operators.similarity import match_by_similarity, top1
from ..params import DEFAULT_PARAMS
from ..sources import fixtures as fx
from ..sources.tables import brands_from_table, dense_position, leads_from_table, rule_meta, rules_from_table
from . import report
from .cascade import cascade, distinct_texts, per_text_results

P = DEFAULT_PARAMS


def _r6(c):
    return F.round(c, 6)


def _leads_t(df: DataFrame) -> DataFrame:
    return df.withColumn("_t", strip("lead_name"))


# --------------------------------------------------------------------------- text functions

def q_strip_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", strip("text").alias("stripped"), F.length(strip("text")).cast("bigint").alias("n"),
                    cell_text("source").alias("source"))


def keyword_cells(spark, sf):
    """Keyword cells built from part rows: separators , ， 、, padding and full-width spaces."""
    p = fx.table(spark, sf, "part")
    cell = F.concat(F.lit("　"), F.col("p_name"), F.lit(" ，"), F.col("p_brand"), F.lit("、 "),
                    F.col("p_type"), F.lit(",,"), F.when(F.col("p_size") > 25, F.lit(" 、")).otherwise(F.lit("")))
    return p.select("p_partkey", cell.alias("cell"))


def q_split_keywords(spark, sf):
    c = keyword_cells(spark, sf)
    kw = split_keywords("cell")
    return c.select("p_partkey", F.array_join(kw, "|").alias("keywords"), F.size(kw).cast("bigint").alias("n"))


def q_mask_secret(spark, sf):
    c = fx.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        mask_secret("c_name").alias("m_name"),
        mask_secret(F.concat(F.lit("sk-"), key)).alias("m_short"),
        mask_secret(F.concat(F.lit("sk-"), F.lpad(key, 10, "0"))).alias("m_long"),
        mask_secret(F.concat(F.lit(" "), F.substring(F.col("c_mktsegment"), 1, 6), F.lit(" "))).alias("m_seg"),
        mask_secret(F.lit(None).cast("string")).alias("m_null"))


def q_url_origin(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", url_origin("url").alias("origin"),
                    url_origin(F.concat(F.lit("  "), F.col("url"), F.lit("//"))).alias("origin_padded"),
                    url_origin(F.regexp_replace("url", "^https?://", "ftp://")).alias("origin_other"),
                    url_origin(F.regexp_replace("url", ".*", "")).alias("origin_blank"))


def q_ellipsize(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", summary("text", 80).alias("s80"), ellipsize(strip("text"), 50).alias("item"),
                    summary("text", 120).alias("s120"))


def q_cell_values(spark, sf):
    """E1/E3/E5 over lineitem values rendered as text cells."""
    li = fx.table(spark, sf, "lineitem")
    qty = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))
    lst = F.array(F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"), F.lit(None).cast("string"))
    return li.select("l_orderkey", "l_linenumber",
                     to_int0(qty).alias("qty_int"),
                     to_int0(F.col("l_returnflag")).alias("flag_int"),
                     to_int0(F.lit(None).cast("string")).alias("null_int"),
                     to_int0(F.concat(F.lit("-"), F.col("l_discount").cast("string"))).alias("neg_int"),
                     F.array_join(clean_list(lst), "|").alias("flags"),
                     cell_text(F.col("l_tax")).alias("tax_text"),
                     # as in Python: a type suffix or a hexadecimal form is no number, underscores between
                     # digits and digits of other scripts are
                     to_int0(F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_quantity") > 25, "d").otherwise("f"))).alias("suffix_int"),
                     to_int0(F.concat(F.lit("1_00"), F.col("l_linenumber").cast("string"))).alias("under_int"),
                     to_int0(F.translate(F.col("l_linenumber").cast("string"), "0123456789", "０１２３４５６７８９")).alias("wide_int"),
                     to_int0(F.concat(F.lit("0x"), F.col("l_linenumber").cast("string"), F.lit("p0"))).alias("hex_int"))


# --------------------------------------------------------------------------- rules

def q_rule_predicate(spark, sf):
    leads = _leads_t(fx.part_leads(spark, sf))
    cols = []
    for i, g1, g2, g5, no in fx.RULE_FIXTURE:
        cols.append(rule_predicate("_t", literal_rule(g1=g1, g2=g2, g5=g5, must_not=no)).alias(f"r{i}"))
    return leads.select("lead_idx", *cols)


def q_rule_join(spark, sf):
    leads = _leads_t(fx.part_leads(spark, sf))
    return match_rules(leads, fx.rules(spark), "_t", ["lead_idx"], P)


def q_rule_join_anchor(spark, sf):
    docs = _leads_t(fx.document_leads(spark, sf))
    return match_rules(docs, fx.rules(spark), "_t", ["lead_idx"], P.with_(rule_plan="anchor"))


def q_rule_join_docs(spark, sf):
    docs = _leads_t(fx.document_leads(spark, sf))
    return match_rules(docs, fx.rules(spark), "_t", ["lead_idx"], P)


def q_rule_unmatched(spark, sf):
    leads = _leads_t(fx.part_leads(spark, sf))
    out = rules_left(leads, fx.rules(spark), "_t", ["lead_idx", "_t"], P)
    return out.select("lead_idx", "level1", "code", "atomic", "n_rules")


def q_rule_collapse(spark, sf):
    """A1 over whole documents: compiled rules give the collapsed columns in one projection."""
    docs = _leads_t(fx.document_leads(spark, sf)).select("lead_idx", "_t")
    out = rules_left(docs, fx.rules(spark), "_t", ["lead_idx", "_t"], P)
    return out.where(F.col("n_rules") > 0).select("lead_idx", "level1", "code", "atomic", "n_rules")


def q_rule_collapse_sheet(spark, sf):
    """A1 with the parsed sheet's thousands of rules: anchor plan, collapsed once per hit set."""
    docs = _leads_t(fx.document_leads(spark, sf)).select("lead_idx", "_t")
    out = rules_left(docs, rules_from_table(raw_rule_sheet(spark, sf)), "_t", ["lead_idx"], P)
    return out.where(F.col("n_rules") > 0).select("lead_idx", "level1", "code", "atomic", "n_rules")


# --------------------------------------------------------------------------- loaders

RULE_SHEET_HEADER = (
    ("判断逻辑", "", "", "", "需同时包含", "需同时包含", "需同时包含", "需同时包含", "任意包含其一", "一定不包含", "说明"),
    ("一级原子品类", "品类编码", "原子品类", "序号", "关键词组1", "关键词组2", "关键词组3", "关键词组4", "关键词组5",
     "一定不包含"),
)


def raw_rule_sheet(spark, sf):
    """A positional rule sheet: two literal header rows, then one data row per part."""
    p = fx.table(spark, sf, "part")
    words = F.split("p_name", " ")
    cells = F.array(
        F.concat(F.lit(" "), F.col("p_type"), F.lit("　")),
        F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_size").cast("string")),
        F.col("p_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(".9")),
        F.concat(F.element_at(words, 1), F.lit("，"), F.element_at(words, 2)),
        F.element_at(words, 2),
        F.lit(None).cast("string"),
        F.lit(" "),
        F.concat(F.col("p_brand"), F.lit("、"), F.element_at(words, 1)),
        F.when(F.col("p_retailprice") > 1500, F.lit("old,x")).otherwise(F.lit("")),
    )
    data = p.select((F.col("p_partkey") + 2).alias("row_idx"),
                    F.concat(F.slice(cells, 1, F.lit(3) + F.col("p_size") % 8),
                             # trailing notes beyond the header, as many as the data say
                             F.when(F.col("p_size") % 8 == 7, F.expr("array_repeat(p_type, cast(p_partkey % 7 as int))"))
                             .otherwise(F.array().cast("array<string>"))).alias("cells"))
    head = spark.createDataFrame([(i, list(r)) for i, r in enumerate(RULE_SHEET_HEADER)], "row_idx long, cells array<string>")
    return head.unionByName(data)


def _rules_flat(r: DataFrame) -> DataFrame:
    return r.select("rule_idx", "level1", "code", "atomic", "sequence_no",
                    *[F.array_join(g, "|").alias(g) for g in ("g1", "g2", "g3", "g4", "g5", "must_not")])


def q_rules_parse(spark, sf):
    return _rules_flat(rules_from_table(raw_rule_sheet(spark, sf)))


def q_rule_meta(spark, sf):
    return rule_meta(raw_rule_sheet(spark, sf))


def raw_brand_sheet(spark, sf):
    """A header sheet of brands built from embeddings: some blank names, some blank codes."""
    nv = fx.brands(spark, sf)
    return nv.select(
        F.col("brand_idx").alias("row_idx"),
        F.when(F.col("brand_idx") % 9 == 0, F.lit(None)).otherwise(F.col("brand_code")).alias("品牌编码"),
        F.when(F.col("brand_idx") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("brand_name"))).alias("品牌名称"),
        F.lit("a，b").alias("品牌关键词（，表示同时包含）"),
        F.col("atomic").alias(" 原子品类 "),
    )


def q_brands_parse(spark, sf):
    b = brands_from_table(raw_brand_sheet(spark, sf))
    return b.select("brand_idx", "brand_code", "brand_name", "brand_keywords", "atomic")


def raw_lead_sheet(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("row_idx"),
                    F.concat(F.lit(" P"), F.col("p_partkey").cast("string")).alias("线索编码"),
                    F.when(F.col("p_size") == 1, F.lit("　")).otherwise(F.col("p_name")).alias("线索名称"),
                    F.col("p_brand").alias("其他"))


def q_leads_parse(spark, sf):
    return leads_from_table(raw_lead_sheet(spark, sf))


def q_keyword_top_n(spark, sf):
    return keyword_top_n(rules_from_table(raw_rule_sheet(spark, sf)), P.max_keyword_examples)


def q_keyword_hint(spark, sf):
    return keyword_hint(rules_from_table(raw_rule_sheet(spark, sf)), P.max_keyword_examples, 40)


def q_category_nodes(spark, sf):
    r = fx.table(spark, sf, "region").select(
        F.concat(F.lit(" "), F.col("r_regionkey").cast("string")).alias("id"),
        F.concat(F.col("r_name"), F.lit("　")).alias("name"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("parent_id"))
    n = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        (F.lit(2) - F.when(F.col("n_nationkey") == 24, F.lit(3)).otherwise(F.lit(0))).alias("level"),
        F.col("n_regionkey").cast("string").alias("parent_id"))
    return report.category_nodes(r.unionByName(n))


# --------------------------------------------------------------------------- similarity

def vector_pairs(spark, sf):
    """Equi-joined (text, brand) pairs: each text with the brand of its own (odd) id or the next."""
    t = fx.vector_leads(spark, sf)
    b = fx.brands(spark, sf)
    return t.join(b, b.brand_idx == t.lead_idx + 1 - F.pmod(t.lead_idx, F.lit(2))).select(
        "lead_idx", "brand_idx", "lead_name", "brand_name",
        t.embedding.alias("lv"), b.embedding.alias("bv"))


def q_jaro_winkler_pairs(spark, sf):
    p = vector_pairs(spark, sf)
    return p.select("lead_idx", "brand_idx", _r6(sim.jaro_winkler_udf("lead_name", "brand_name")).alias("jw"),
                    _r6(sim.jaro_winkler_udf(F.lower("lead_name"), F.reverse("brand_name"))).alias("jw_other"))


def q_cosine_pairs(spark, sf):
    p = vector_pairs(spark, sf)
    cos = sim.cosine("lv", "bv", "lead_name", "brand_name")
    return p.select("lead_idx", "brand_idx", _r6(cos).alias("cos"), _r6(sim.cos01(cos)).alias("cos01"))


def q_combined_pairs(spark, sf):
    p = vector_pairs(spark, sf)
    c = sim.combined_similarity("lv", "bv", "lead_name", "brand_name", 0.5)
    c7 = sim.combined_similarity("lv", "bv", "lead_name", "brand_name", 0.7)
    return p.select("lead_idx", "brand_idx", _r6(sim.clamp01(c)).alias("combined"),
                    _r6(sim.clamp01(c7)).alias("combined_w07"))


def _top1_query(spark, sf, params, plan="auto"):
    t = _leads_t(fx.vector_leads(spark, sf))
    best = top1(t, fx.brands(spark, sf), ["lead_idx"], "_t", "embedding", params, plan)
    return best.select("lead_idx", "brand_idx", _r6(F.col("score")).alias("score"), "score_text")


def q_sim_top1(spark, sf):
    return _top1_query(spark, sf, P)


def q_sim_top1_grid(spark, sf):
    return _top1_query(spark, sf, P.with_(grid_blocks=4, grid_buckets=4), "grid")


def q_sim_top1_vector_only(spark, sf):
    return _top1_query(spark, sf, P.with_(use_combined=False))


def q_sim_top1_names(spark, sf):
    """Texts without vectors (part names): the cosine part is 0, ties go to the lowest index."""
    t = distinct_texts(fx.part_leads(spark, sf))
    best = top1(t, fx.brands(spark, sf), ["_t"], "_t", "_v", P)
    return best.select(F.col("_t").alias("text"), "brand_idx", _r6(F.col("score")).alias("score"), "score_text")


def q_sim_match(spark, sf):
    t = _leads_t(fx.vector_leads(spark, sf))
    m = match_by_similarity(t, fx.brands(spark, sf), ["lead_idx"], "_t", "embedding",
                            P.with_(similarity_threshold=0.75))
    return m.select("lead_idx", "brand_idx", "brand_name", "brand_code", "brand_atomic",
                    _r6(F.col("score")).alias("score"))


# --------------------------------------------------------------------------- cascade

def _cascade_part(spark, sf, **kw):
    return cascade(fx.part_leads(spark, sf), fx.rules(spark), fx.brands(spark, sf),
                   descriptions=fx.part_descriptions(spark, sf), **kw)


def _cascade_vectors(spark, sf, **kw):
    return cascade(fx.vector_leads(spark, sf), fx.rules(spark), fx.brands(spark, sf),
                   descriptions=fx.vector_descriptions(spark, sf), **kw)


def _with_score6(df):
    return df.withColumn("score", _r6(F.col("score")))


def q_cascade_full(spark, sf):
    return _with_score6(_cascade_part(spark, sf))


def q_cascade_vectors(spark, sf):
    return _with_score6(_cascade_vectors(spark, sf))


def q_error_rows(spark, sf):
    """C4: texts whose vector is corrupt become error rows; every other row is unaffected."""
    out = cascade(fx.vector_leads_damaged(spark, sf), fx.rules(spark), fx.brands(spark, sf),
                  descriptions=fx.vector_descriptions(spark, sf))
    return _with_score6(out)


def q_cascade_lineitem(spark, sf):
    """The full cascade over lineitem leads with one hot name (a quarter of all rows)."""
    out = cascade(fx.lineitem_leads(spark, sf), fx.rules(spark), fx.brands(spark, sf),
                  descriptions=fx.part_descriptions(spark, sf))
    return out.select("lead_idx", "lead_code", "method", "atomic", "sim_brand", "sim_score", "llm_desc")


def q_rule_join_sheet(spark, sf):
    """Whole documents against the rule table parsed from the part-derived sheet
    (thousands of rules: above the compile bound, so the anchor plan runs)."""
    docs = _leads_t(fx.document_leads(spark, sf))
    rules = rules_from_table(raw_rule_sheet(spark, sf))
    return match_rules(docs, rules, "_t", ["lead_idx"], P).select("lead_idx", "rule_idx", "atomic")


def q_output_names(spark, sf):
    """S11 per source stem of the documents (one stem is on the ignore list)."""
    src = fx.table(spark, sf, "documents").select(F.col("source").alias("stem")).distinct()
    return src.select("stem", report.output_name_col("stem", "20260101_000000", "src3").alias("output_name"))


def q_table_counts(spark, sf):
    """Rows loaded per input (parsed rule sheet, brand sheet, lead sheet)."""
    return report.table_counts_frame(rules=rules_from_table(raw_rule_sheet(spark, sf)),
                                     brands=brands_from_table(raw_brand_sheet(spark, sf)),
                                     leads=leads_from_table(raw_lead_sheet(spark, sf)))


def q_workbook_roundtrip(spark, sf):
    """Part leads written as 4 .xlsx workbooks to the shared folder, one with its columns
    swapped and one with a repeated header, read back in parallel, each by its own header."""
    import uuid
    from ..session import checkpoint_dir_or_local
    from ..sources.tables import leads_from_workbooks
    from ..sources.workbooks import read_workbooks, write_workbooks
    base = f"{checkpoint_dir_or_local(spark).rstrip('/')}/workbooks-{uuid.uuid4().hex}"
    parts = fx.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("code"), "p_name")
    for k, header in enumerate((["线索编码", "线索名称"], [" 线索名称 ", "线索编码"], ["线索编码", "线索名称", "线索名称"], ["线索编码", "线索名称"])):
        rows = parts.where(F.pmod("p_partkey", F.lit(4)) == k).orderBy("p_partkey")
        cols = ["p_name", "code"] if header[0].strip() == "线索名称" else ["code", "p_name"]
        cells = [F.col(c) for c in cols] + [F.lit("other").alias("c3")] * (len(header) - 2)
        write_workbooks(rows.select(*cells), f"{base}/leads-{k}", header, 1).collect()  # returns the path, not data
    leads = leads_from_workbooks(read_workbooks(spark, f"{base}/*/*.xlsx"))
    return leads.select(F.regexp_extract("path", "(leads-[0-9])/[^/]*$", 1).alias("file"), "lead_idx", "lead_code", "lead_name")


def q_workbook_dates(spark, sf):
    """Order dates written as date cells of .xlsx workbooks (a file per partition) and read back as text."""
    import uuid
    from ..session import checkpoint_dir_or_local
    from ..sources.workbooks import read_workbooks, write_workbooks
    base = f"{checkpoint_dir_or_local(spark).rstrip('/')}/workbooks-{uuid.uuid4().hex}"
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    write_workbooks(orders, base, ["key", "date"], spark.sparkContext.defaultParallelism).collect()  # the paths, not data
    rows = read_workbooks(spark, f"{base}/*.xlsx").where("row_idx > 0")
    return rows.select(F.col("cells")[0].cast("long").alias("o_orderkey"), F.col("cells")[1].alias("shown"))


def q_results_sink(spark, sf):
    """S7 + the batch job: per-text stage checkpointed, results written in input order, read back."""
    import uuid
    from ..params import RESULT_COLUMNS
    from ..session import checkpoint_dir_or_local
    from .job import run_job
    out = f"{checkpoint_dir_or_local(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    run_job(spark, fx.part_leads(spark, sf), fx.rules(spark), fx.brands(spark, sf), out,
            descriptions=fx.part_descriptions(spark, sf))
    return spark.read.parquet(out).select("lead_idx", *RESULT_COLUMNS)


def q_result_rows(spark, sf):
    from ..params import RESULT_COLUMNS
    return _cascade_vectors(spark, sf).select("lead_idx", *RESULT_COLUMNS)


def q_method_label(spark, sf):
    return _cascade_part(spark, sf).select("lead_idx", "method")


def q_reattach_duplicates(spark, sf):
    from ..params import RESULT_COLUMNS
    return cascade(fx.part_leads(spark, sf), fx.rules(spark), None).select("lead_idx", *RESULT_COLUMNS)


def q_describe_join(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    return describe(names, "text", fx.part_descriptions(spark, sf))


def q_describe_rematch(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    d = describe(names, "text", fx.part_descriptions(spark, sf))
    d = d.where(F.col("description").isNotNull() & ~F.col("description").isin(*P.unmatched_aliases))
    return rules_left(d, fx.rules(spark), "description", ["text", "description"], P)


def q_fallback_requests(spark, sf):
    rules = fx.rules(spark)
    names = distinct_texts(fx.vector_leads(spark, sf))
    rest = rules_left(names, rules, "_t", ["_t", "_vh", "_v"], P).where(F.col("n_rules") == 0)
    best = match_by_similarity(rest, fx.brands(spark, sf), ["_t", "_vh"], "_t", "_v", P)
    below = best.where(F.col("brand_idx").isNotNull() & (F.col("score") < P.fallback_threshold))
    hint = keyword_hint_text(rules, P.max_keyword_examples, P.max_keyword_hint_chars)
    return fallback_requests(below, "_t", "score_text", hint, P.fallback_threshold)


# --------------------------------------------------------------------------- reports

def q_match_counts(spark, sf):
    return report.match_counts(_cascade_part(spark, sf))


def q_chunk_progress(spark, sf):
    """A3 over parsed leads: blank rows leave gaps in the row numbers, so chunks go by dense position."""
    leads = leads_from_table(raw_lead_sheet(spark, sf))
    out = cascade(leads, fx.rules(spark), fx.brands(spark, sf), descriptions=fx.part_descriptions(spark, sf))
    return report.chunk_progress(dense_position(out.select("lead_idx", "method"), ["lead_idx"], "pos"), 500, "pos")


def q_append_sink(spark, sf):
    """The results appended chunk by chunk (the last one empty) and read back."""
    import uuid
    from ..params import RESULT_COLUMNS
    from ..session import checkpoint_dir_or_local, materialized
    path = f"{checkpoint_dir_or_local(spark).rstrip('/')}/appended-{uuid.uuid4().hex}"
    out = materialized(_cascade_part(spark, sf).select("lead_idx", *RESULT_COLUMNS))
    for part in (F.pmod("lead_idx", F.lit(2)) == 0, F.pmod("lead_idx", F.lit(2)) == 1, F.lit(False)):
        report.append_results(out.where(part), path)
    return spark.read.parquet(path)


def q_committed_append(spark, sf):
    """S8 with repeated and broken chunks: a chunk appended twice counts once, one that was never published not at all."""
    import uuid
    from ..params import RESULT_COLUMNS
    from ..session import checkpoint_dir_or_local, materialized
    from .committed import CommittedSink, success_counts
    sink = CommittedSink(spark, f"{checkpoint_dir_or_local(spark).rstrip('/')}/committed-{uuid.uuid4().hex}")
    out = materialized(_cascade_part(spark, sf).select("lead_idx", *RESULT_COLUMNS))
    chunk = F.pmod(F.xxhash64("lead_idx"), F.lit(3))
    out.where(chunk == 1).write.parquet(f"{sink.path}/rows/chunk=1/attempt=broken")
    for n in (0, 1, 1, 2, 0):
        sink.append(out.where(chunk == n), n, success_counts(), order="lead_idx")
    return sink.read(out.schema).drop("chunk")


def q_compact_records(spark, sf):
    """C7 and its inverse: records from the compact rows, read out again."""
    rec = report.from_compact_rows(report.compact_rows(_cascade_vectors(spark, sf)))
    return rec.select("lead_idx", "record.*")


def q_l2_normalize(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(l2_normalize("embedding"), lambda x: F.round(x, 6)).alias("v"))


def q_rule_join_literal(spark, sf):
    return match_rules(_leads_t(fx.literal_leads(spark, sf)), fx.literal_rules(spark), "_t", ["lead_idx"], P)


def benchmark_rules(spark, sf):
    """One rule per benchmark item: its first two words all, any of the others. Its hundreds of common
    keywords give nearly every document a hit set of its own."""
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]+", " "), " "), lambda w: w != "")
    none = F.array().cast("array<string>")
    rows = fx.table(spark, sf, "benchmark").select("item_id", words.alias("w")).select(
        F.col("item_id").alias("rule_idx"), F.lit("bench").alias("level1"), F.col("item_id").cast("string").alias("code"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("atomic"), F.lit(0).cast("bigint").alias("sequence_no"),
        F.slice("w", 1, 2).alias("g1"), *[none.alias(g) for g in ("g2", "g3", "g4")],
        F.array_distinct(F.slice("w", 3, 1000)).alias("g5"), none.alias("must_not"))
    return rows


def q_rule_join_words(spark, sf):
    docs = _leads_t(fx.document_leads(spark, sf))
    return match_rules(docs, benchmark_rules(spark, sf), "_t", ["lead_idx"], P).select("lead_idx", "rule_idx", "atomic")


def q_rule_join_grams(spark, sf):
    """The rules of common words over whole documents, each twice, with a dictionary partitioned by q-grams."""
    docs = _leads_t(fx.document_leads(spark, sf))
    rules = benchmark_rules(spark, sf)
    return match_rules(docs.unionByName(docs), rules, "_t", ["lead_idx"], P.with_(max_broadcast_keywords=50)).select("lead_idx", "rule_idx", "atomic")


def q_cascade_sheet(spark, sf):
    """The full cascade with the parsed sheet's rules (anchor plan, also over the descriptions)."""
    out = cascade(fx.part_leads(spark, sf), rules_from_table(raw_rule_sheet(spark, sf)), fx.brands(spark, sf),
                  descriptions=fx.part_descriptions(spark, sf))
    return _with_score6(out)


def q_cascade_documents(spark, sf):
    """Whole documents against all brands: the kernel on long texts."""
    out = cascade(fx.ascii_document_leads(spark, sf), fx.rules(spark), fx.brands(spark, sf),
                  descriptions=fx.part_descriptions(spark, sf))
    return _with_score6(out).select("lead_idx", "atomic", "method", "sim_brand", "score")


def q_nested_view(spark, sf):
    from ..params import RESULT_COLUMNS
    nested = report.nested_view(_cascade_vectors(spark, sf).select("lead_idx", *RESULT_COLUMNS))
    return report.display_view(report.flat_view(nested))


def q_flag_failed(spark, sf):
    return report.flag_failed(_cascade_part(spark, sf)).select("lead_idx", "method", "is_failed")


def q_compact_rows(spark, sf):
    return report.compact_rows(_cascade_vectors(spark, sf))


def q_per_text(spark, sf):
    """The cascade's per-text decision table (J9 input), before re-attachment."""
    names = distinct_texts(fx.part_leads(spark, sf))
    pt = per_text_results(names, fx.rules(spark), fx.brands(spark, sf), fx.part_descriptions(spark, sf), None, P)
    return pt.select(F.col("_t").alias("text"), "m_n", "m_atomic", "from_sim", F.col("ref_idx").alias("brand_idx"),
                     _r6(F.col("score")).alias("score"), "llm_desc")


QUERIES = {
    "strip_text": q_strip_text,
    "split_keywords": q_split_keywords,
    "cell_values": q_cell_values,
    "mask_secret": q_mask_secret,
    "url_origin": q_url_origin,
    "ellipsize": q_ellipsize,
    "rule_predicate": q_rule_predicate,
    "rule_join": q_rule_join,
    "rule_join_docs": q_rule_join_docs,
    "rule_join_anchor": q_rule_join_anchor,
    "rule_unmatched": q_rule_unmatched,
    "rule_collapse": q_rule_collapse,
    "rule_collapse_sheet": q_rule_collapse_sheet,
    "rules_parse": q_rules_parse,
    "rule_meta": q_rule_meta,
    "brands_parse": q_brands_parse,
    "leads_parse": q_leads_parse,
    "keyword_top_n": q_keyword_top_n,
    "keyword_hint": q_keyword_hint,
    "category_nodes": q_category_nodes,
    "jaro_winkler_pairs": q_jaro_winkler_pairs,
    "cosine_pairs": q_cosine_pairs,
    "combined_pairs": q_combined_pairs,
    "sim_top1": q_sim_top1,
    "sim_top1_grid": q_sim_top1_grid,
    "sim_top1_vector_only": q_sim_top1_vector_only,
    "sim_top1_names": q_sim_top1_names,
    "sim_match": q_sim_match,
    "describe_join": q_describe_join,
    "describe_rematch": q_describe_rematch,
    "fallback_requests": q_fallback_requests,
    "per_text": q_per_text,
    "cascade_full": q_cascade_full,
    "cascade_vectors": q_cascade_vectors,
    "result_rows": q_result_rows,
    "results_sink": q_results_sink,
    "workbook_roundtrip": q_workbook_roundtrip,
    "workbook_dates": q_workbook_dates,
    "output_names": q_output_names,
    "table_counts": q_table_counts,
    "cascade_lineitem": q_cascade_lineitem,
    "rule_join_sheet": q_rule_join_sheet,
    "error_rows": q_error_rows,
    "method_label": q_method_label,
    "reattach_duplicates": q_reattach_duplicates,
    "match_counts": q_match_counts,
    "chunk_progress": q_chunk_progress,
    "nested_view": q_nested_view,
    "flag_failed": q_flag_failed,
    "compact_rows": q_compact_rows,
    "append_sink": q_append_sink,
    "committed_append": q_committed_append,
    "compact_records": q_compact_records,
    "l2_normalize": q_l2_normalize,
    "rule_join_literal": q_rule_join_literal,
    "rule_join_words": q_rule_join_words,
    "rule_join_grams": q_rule_join_grams,
    "cascade_sheet": q_cascade_sheet,
    "cascade_documents": q_cascade_documents,
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)


def q_encode_join(spark, sf):
    """Distinct part names encoded once, re-attached to every lead (rows-only check)."""
    from ..operators.encode import encode_texts
    leads = fx.part_leads(spark, sf).drop("embedding")
    names = leads.select("lead_name").distinct()
    vec = encode_texts(names, "lead_name")
    out = leads.join(vec, "lead_name")
    return out.select("lead_idx", F.size("embedding").cast("bigint").alias("dim"),
                      _r6(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
