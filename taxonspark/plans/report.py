"""Sinks, views and reports over cascade results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import cell_text
from ..params import (LLM_DESC_TITLE, OUTPUT_NAME_TAG, RESULT_COLUMNS, RESULT_HEADER, SIMILARITY_GROUP_TITLE,
                      SUCCESS_METHODS)

SIMILARITY_FIELDS = ("sim_brand", "sim_code", "sim_atomic", "sim_score")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", counts: dict | None = None) -> dict:
    """Overwrite sink, rows in input order (range-partitioned sort on ``lead_idx``). ``counts`` are aggregates observed on
    the rows as they are written (A2 without a second reading), returned by name."""
    seen = Observation()
    rows = df.orderBy("lead_idx")
    if counts:
        rows = rows.observe(seen, *[c.alias(n) for n, c in counts.items()])
    rows.write.mode("overwrite").format(fmt).option("header", "true").save(path)
    return seen.get if counts else {}


def append_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append one chunk as it comes; appending an empty chunk leaves no files behind. For chunks that may be repeated or broken
    off see ``plans/committed``."""
    df.sortWithinPartitions("lead_idx").write.mode("append").format(fmt).option("header", "true").save(path)


def nested_view(df: DataFrame) -> DataFrame:
    """The four similarity columns grouped in one struct column."""
    others = [c for c in df.columns if c not in SIMILARITY_FIELDS]
    sim = F.struct(*[F.col(c).alias(c[4:]) for c in SIMILARITY_FIELDS]).alias("similarity")
    before = [c for c in others if c != "llm_desc"]
    return df.select(*before, sim, *(["llm_desc"] if "llm_desc" in df.columns else []))


def flat_view(df: DataFrame) -> DataFrame:
    """S9 inverse: struct back to the four flat columns."""
    others = [c for c in df.columns if c != "similarity"]
    before = [c for c in others if c != "llm_desc"]
    return df.select(*before, *[F.col(f"similarity.{c[4:]}").alias(c) for c in SIMILARITY_FIELDS],
                     *(["llm_desc"] if "llm_desc" in df.columns else []))


def display_view(df: DataFrame) -> DataFrame:
    """S9 for display: the 11 columns under their two-level header, joined with '/'."""
    names = []
    for c, h in zip(RESULT_COLUMNS, RESULT_HEADER):
        names.append(f"{SIMILARITY_GROUP_TITLE}/{h}" if c in SIMILARITY_FIELDS else h)
    names[-1] = LLM_DESC_TITLE
    extra = [c for c in df.columns if c not in RESULT_COLUMNS]
    return df.select(*extra, *[F.col(c).alias(n) for c, n in zip(RESULT_COLUMNS, names)])


def flag_failed(df: DataFrame) -> DataFrame:
    """A row failed when its method is not one of the three success labels."""
    return df.withColumn("is_failed", ~F.col("method").isin(*SUCCESS_METHODS))


def output_name(stem: str | None, stamp: str, ignore: str | None = None) -> str:
    """``{stem}_匹配结果_{stamp}``, or ``匹配结果_{stamp}`` without a usable stem."""
    if not stem or (ignore is not None and stem == ignore):
        return f"{OUTPUT_NAME_TAG}_{stamp}"
    return f"{stem}_{OUTPUT_NAME_TAG}_{stamp}"


def output_name_col(stem, stamp: str, ignore: str | None = None):
    """S11 as a Column (e.g. one output folder per source stem): same rule as ``output_name``."""
    st = F.coalesce(F.col(stem) if isinstance(stem, str) else stem, F.lit(""))
    plain = F.lit(f"{OUTPUT_NAME_TAG}_{stamp}")
    named = F.concat(st, F.lit(f"_{OUTPUT_NAME_TAG}_{stamp}"))
    cond = (st == "") if ignore is None else ((st == "") | (st == F.lit(ignore)))
    return F.when(cond, plain).otherwise(named)


def table_counts_frame(**tables: DataFrame) -> DataFrame:
    """A6 as one small DataFrame ``(table, n)``: one partial/final count per input, unioned."""
    frames = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("table"), "n")
              for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def match_counts(df: DataFrame) -> DataFrame:
    """A2: success / failed / total in one pass."""
    ok = F.col("method").isin(*SUCCESS_METHODS)
    return df.agg(F.count_if(ok).cast("bigint").alias("n_success"),
                  F.count_if(~ok).cast("bigint").alias("n_failed"),
                  F.count(F.lit(1)).cast("bigint").alias("n_total"))


def chunk_progress(df: DataFrame, size: int, order_col: str = "lead_idx", block: int = 4096) -> DataFrame:
    """A3: per chunk ``floor(position / size)``: rows, successes, running total and percent.

    ``order_col`` is the dense 0-based position from the source. The running total is a
    two-level prefix sum, so no task ever holds more than ``block`` chunks: chunk counts ->
    per-block totals -> offsets of the blocks (a ``block``-times smaller table) -> running
    sum inside each block (window partitioned by block) plus the block's offset.
    """
    ok = F.col("method").isin(*SUCCESS_METHODS)
    per = (df.groupBy(F.floor(F.col(order_col) / F.lit(size)).cast("bigint").alias("chunk"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.count_if(ok).cast("bigint").alias("n_success"))
           .withColumn("_blk", F.floor(F.col("chunk") / F.lit(block)).cast("bigint")))
    totals = per.groupBy("_blk").agg(F.sum("n_rows").cast("bigint").alias("_bt"))
    upto = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_off", F.coalesce(F.sum("_bt").over(upto), F.lit(0)).cast("bigint"))
               .withColumn("total", F.sum("_bt").over(Window.partitionBy(F.lit(1))).cast("bigint")))
    inside = Window.partitionBy("_blk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (per.withColumn("_run", F.sum("n_rows").over(inside))
           .join(offsets.select("_blk", "_off", "total"), "_blk")
           .withColumn("processed", (F.col("_run") + F.col("_off")).cast("bigint")))
    return out.select("chunk", "n_rows", "n_success", "processed", "total",
                      F.round(F.lit(100.0) * F.col("processed") / F.col("total"), 1).alias("percent"))


def table_counts(**tables: DataFrame) -> dict[str, int]:
    """Row counts reported after loading (driver-side scalars)."""
    return {k: v.count() for k, v in tables.items()}


def compact_rows(df: DataFrame) -> DataFrame:
    """The 7-column record; null -> "", stripped."""
    return df.select(
        *[c for c in ("lead_idx",) if c in df.columns],
        cell_text("lead_name").alias("raw_text"), cell_text("level1").alias("level1"),
        cell_text("code").alias("code"), cell_text("atomic").alias("atomic"), cell_text("method").alias("method"),
        cell_text("sim_brand").alias("similarity_detail"), cell_text("llm_desc").alias("llm_desc"))


def from_compact_rows(df: DataFrame) -> DataFrame:
    """C7 inverse: a struct per record with the same normalisation."""
    fields = ("raw_text", "level1", "code", "atomic", "method", "similarity_detail", "llm_desc")
    return df.select(*[c for c in df.columns if c not in fields],
                     F.struct(*[cell_text(f).alias(f) for f in fields]).alias("record"))


def category_nodes(df: DataFrame) -> DataFrame:
    """Strip id/name/parent_id (null -> ""), level default 1; ``valid`` = level >= 0."""
    level = F.coalesce(F.col("level").cast("int"), F.lit(1)) if "level" in df.columns else F.lit(1)
    return df.select(cell_text("id").alias("id"), cell_text("name").alias("name"), level.alias("level"),
                     cell_text("parent_id").alias("parent_id"), (level >= 0).alias("valid"))
