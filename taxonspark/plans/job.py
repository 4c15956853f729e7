"""The batch job (the reference's file run): load inputs, run the cascade, write results.

Inputs may be parquet tables or .xlsx workbooks (read in parallel with ``read_workbooks``).
Results are written in input order (S7) and the success / failure counts (A2) returned.
With ``materialize=True`` the per-text decisions — the expensive stage (kernel and
describer) — are written to the shared checkpoint folder (``spark.checkpoint.dir``) before
the re-attachment, so losing executors afterwards never re-runs that stage.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import prepare_rules
from ..operators.similarity import prepare_brands
from ..params import DEFAULT_INPUT_STEM_IGNORE, DEFAULT_PARAMS, RESULT_COLUMNS, SUCCESS_METHODS, Params
from ..session import materialized
from ..sources.tables import brands_from_workbooks, leads_from_workbooks, rules_from_table, workbook_errors
from ..sources.workbooks import read_workbooks
from . import report
from .committed import success_counts
from .cascade import cascade, distinct_texts, per_text_results, reattach, method_label, result_columns


def _load(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".xlsx") or "*.xlsx" in path:
        return read_workbooks(spark, path)
    return spark.read.parquet(path)


def load_inputs(spark: SparkSession, leads_path: str, rules_path: str, brands_path: str | None):
    """Leads and brands from header sheets, rules from a positional sheet (or typed tables)."""
    raw_leads = _load(spark, leads_path)
    leads = raw_leads
    if "cells" in raw_leads.columns:
        bad = workbook_errors(raw_leads).limit(100).collect()
        if bad and len(bad) >= raw_leads.select("path").distinct().limit(101).count():  # no file is usable
            raise ValueError(f"{bad[0].path}: {bad[0].error}")
        leads = leads_from_workbooks(raw_leads)
    raw_rules = _load(spark, rules_path)
    rules = rules_from_table(raw_rules) if "cells" in raw_rules.columns else raw_rules
    brands = None
    if brands_path:
        try:
            raw_brands = _load(spark, brands_path)
            brands = brands_from_workbooks(raw_brands) if "cells" in raw_brands.columns else raw_brands
        except AnalysisException:  # a missing brand file means no verified brands (S3)
            brands = None
    return leads, rules, brands


def run_job(spark: SparkSession, leads: DataFrame, rules: DataFrame, brands: DataFrame | None, out_path: str,
            descriptions: DataFrame | None = None, provider: Callable[[str], str | None] | None = None,
            params: Params = DEFAULT_PARAMS, materialize: bool = True, fmt: str = "parquet",
            encoder: Callable | None = None) -> dict:
    """Run the cascade over ``leads`` and overwrite ``out_path``; returns the counts (A2)."""
    rules = prepare_rules(rules, params)
    if brands is not None and encoder is None:
        brands = prepare_brands(brands, params) or brands
    per_text = per_text_results(distinct_texts(leads), rules, brands, descriptions, provider, params, encoder)
    if materialize:
        per_text = materialized(per_text)
    cols = ["lead_idx", "lead_code", "lead_name", *(["embedding"] if "embedding" in leads.columns else [])]
    joined = reattach(leads.select(*cols), per_text).withColumn("method", method_label(params))
    out = joined.select("lead_idx", *result_columns(params))
    c = report.write_results(out, out_path, fmt, success_counts())
    return {"success": c["n_success"], "failed": c["n_failed"], "total": c["n_success"] + c["n_failed"]}


def run_files(spark: SparkSession, leads: DataFrame, rules: DataFrame, brands: DataFrame | None, out_root: str, stamp: str,
              ignore: str | None = DEFAULT_INPUT_STEM_IGNORE, **kw) -> DataFrame:
    """The cascade over the leads of several input files (``leads_from_workbooks``) in one run, a text in
    many files being decided once; one output folder per input file below ``out_root``, named by S11
    (``output=<name>``). Returns per file: path, output, rows, successes."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    named = leads.withColumn("output", report.output_name_col(stem, stamp, ignore))
    out = cascade(named, rules, brands, extra_cols=("lead_idx", "path", "output"), **kw)
    out = out.select("output", "path", "lead_idx", *RESULT_COLUMNS)
    (out.repartitionByRange("output", "lead_idx").sortWithinPartitions("output", "lead_idx")
     .write.mode("overwrite").partitionBy("output").parquet(out_root))
    ok = F.col("method").isin(*SUCCESS_METHODS)
    return spark.read.parquet(out_root).groupBy("path", "output").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_success"))


def result_view(spark: SparkSession, out_path: str, fmt: str = "parquet") -> DataFrame:
    """The written results with the display header (S9) and the failure flag."""
    df = spark.read.format(fmt).option("header", "true").load(out_path).select("lead_idx", *RESULT_COLUMNS)
    return report.display_view(report.flag_failed(df)).orderBy(F.col("lead_idx"))
