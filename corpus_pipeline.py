"""The corpus pipeline: five filtering and mixing stages over ``documents``, in a fixed order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back
as the next one's input. All but the last return the columns of ``documents``; the last returns the mixed
documents' rates. A stage decides over all that its predecessor kept, by the operator it calls;
every row stands or falls by its own text, whatever its id is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxonspark.llm import decontam, jaccard, langid, linededup, mixing
from taxonspark.llm.common import scratch, staged


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``_row`` each, written once: ids can be null or repeated, so rows are decided by it."""
    return staged(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _without(keyed: DataFrame, rejected: Callable[[], DataFrame]) -> DataFrame:
    """``keyed`` without the rows whose ``_row`` is the doc_id of those ``rejected``, and without its key. Only the decisions stay in the
    shared folder, what the operator staged on the way goes."""
    with scratch(keyed.sparkSession) as keep:
        gone = keep(rejected().select(F.col("doc_id").alias("_gone")), "decided")
    return keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go, no others: the languages and scores that the machines tell
    reject nothing. Where no language was learned the same documents go."""
    keyed = _keyed(docs)

    def rejected() -> DataFrame:
        model = langid.fit(keyed.where(~langid.held_out(F.col("doc_id"))))
        if not model.tree:  # all would be told as und
            return keyed.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(F.col("_row").alias("doc_id"))
        return langid.predict(keyed, model, doc_id="_row").where(F.col("lang_pred") == "und")

    return _without(keyed, rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from the texts; n_chars follows; all documents stay."""
    out = linededup.drop_boilerplate(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row of the smallest id stays (a null id comes last; of one id, the
    smallest hash of the whole row); rows without words are no one's duplicates."""
    keyed = _keyed(docs)

    def rejected() -> DataFrame:
        groups = jaccard.jaccard_groups(keyed.select("_row", "text"), doc_id="_row")
        links = staged(groups.where("doc_id <> component_id").select("doc_id", "component_id"), "groups")
        members = links.unionByName(links.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
        order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64(*docs.columns).alias("c"), F.col("_row").alias("d"))
        members = members.join(keyed.select(F.col("_row").alias("_r"), order.alias("_o")), F.col("doc_id") == F.col("_r"))
        members = staged(members.select("doc_id", "component_id", "_o"), "members")
        first = members.groupBy(F.col("component_id").alias("_c")).agg(F.min("_o")["d"].alias("_first"))
        return members.join(first, F.col("component_id") == F.col("_c")).where("doc_id <> _first")

    return _without(keyed, rejected)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    items, keyed = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _keyed(docs)
    return _without(keyed, lambda: decontam.decontaminate(keyed, items, doc_id="_row").where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates (and whole copies) at which the documents meet the target domain weights."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, labels)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard),
          ("decontamination", decontamination), ("mixing", mix)]

#: learned models can't be put in SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
