"""Chunked, restartable matching with Structured Streaming.

Leads are staged by their position in the input, a folder per chunk of ``params.chunk_size`` rows with as many files as the rows need;
the feed beside them has one small file per chunk, and micro-batch ``n`` takes chunk ``n`` (or ``chunks_per_batch`` of them), so chunks
come in input order whatever the files' times are. A micro-batch decides only the texts that no earlier one has decided: the decisions are kept
in a table by text and vector, published per micro-batch before the results (``plans/committed``). Results and counts are
published chunk by chunk as well, so a batch that is replayed after a failure repeats nothing that was published and a broken one is
not seen. Everything lives under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import DEFAULT_PARAMS, Params
from ..operators.rules import prepare_rules
from ..operators.similarity import BrandIndex, prepare_brands
from ..operators.encode import encode_missing
from ..plans.cascade import RESULT_SCHEMA, attach_results, distinct_texts, per_text_results
from ..plans.committed import COUNTS, CommittedSink, success_counts
from ..session import checkpoint_dir_or_local, materialized
from ..sources.tables import dense_position


def run_chunked(spark: SparkSession, leads_path: str, out_path: str, checkpoint_path: str,
                rules: DataFrame, brands: DataFrame | None, descriptions: DataFrame | None = None,
                provider: Callable[[str], str | None] | None = None, params: Params = DEFAULT_PARAMS,
                chunks_per_batch: int = 1, encoder: Callable | None = None) -> None:
    """Process the leads staged under ``leads_path`` (``stage_leads``) chunk by chunk; returns when all are done."""
    # bounded inputs are prepared once for all micro-batches
    rules = prepare_rules(rules, params)
    if brands is not None and not isinstance(brands, BrandIndex):
        if encoder is not None:
            brands = materialized(encode_missing(brands, "brand_name", "embedding", encoder))
        brands = prepare_brands(brands, params) or brands
    results, decisions = CommittedSink(spark, out_path), CommittedSink(spark, f"{out_path}_decisions")
    staged = spark.read.parquet(f"{leads_path}/rows")
    feed = spark.readStream.schema("chunk long").option("maxFilesPerTrigger", chunks_per_batch).json(f"{leads_path}/feed")

    def process(batch: DataFrame, batch_id: int) -> None:
        if results.published(batch_id) is not None:  # replayed after it was published
            return
        lo = batch_id * chunks_per_batch
        leads = staged.where(F.col("chunk").between(lo, lo + chunks_per_batch - 1)).drop("chunk")
        per_text = decided(leads, batch_id)
        out = attach_results(leads, per_text, params)
        results.append(out, batch_id, success_counts(), order="lead_idx")

    def decided(leads: DataFrame, batch_id: int) -> DataFrame:
        """Per text of ``leads`` its decision: an earlier one, or now. Error rows are not kept: the text is tried again in a later chunk."""
        def decide(names: DataFrame) -> DataFrame:
            return per_text_results(names, rules, brands, descriptions, provider, params, encoder)

        names = distinct_texts(leads)
        kind = decide(names.limit(0)).schema if process.kind is None else process.kind
        process.kind = kind
        known = decisions.read(kind).drop("chunk")
        same = F.col("_t").eqNullSafe(F.col("_kt")) & (F.col("_vh") == F.col("_kvh"))
        new = names.join(known.select(F.col("_t").alias("_kt"), F.col("_vh").alias("_kvh")), same, "left_anti")
        got = materialized(decide(materialized(new)))
        decisions.append(got.where("error is null"), batch_id)
        return decisions.read(kind).drop("chunk").unionByName(got.where("error is not null"))

    process.kind = None
    q = (feed.writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def progress(spark: SparkSession, out_path: str) -> DataFrame:
    """The counts of every finished micro-batch, as observed while it was written, in input order with running totals:
    ``batch_id, n_success, n_failed, n_total, done``."""
    m = CommittedSink(spark, out_path).manifests(COUNTS)
    done = F.sum("n_rows").over(Window.orderBy(F.col("chunk").cast("long")))  # a row per micro-batch
    return m.select(F.col("chunk").cast("long").alias("batch_id"), "n_success", "n_failed", F.col("n_rows").alias("n_total"), done.alias("done"))


def results_so_far(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """The rows of all published micro-batches, with ``chunk``."""
    return CommittedSink(spark, out_path).read(schema)


def stage_leads(leads: DataFrame, path: str, chunk_size: int) -> int:
    """Write leads in input order into a folder per chunk of ``chunk_size`` rows (all in one if 0), each by as many tasks as its rows
    take, and the feed of the chunks; returns their number."""
    placed = dense_position(leads, ["lead_idx"], "_pos")
    size = chunk_size if chunk_size > 0 else 1 << 62
    chunked = placed.withColumn("chunk", F.floor(F.col("_pos") / F.lit(size)).cast("bigint")).drop("_pos")
    chunked.write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/rows")
    n = (chunked.agg(F.max("chunk")).first()[0] or 0) + 1
    spark = leads.sparkSession
    spark.range(n).select(F.col("id").alias("chunk")).repartitionByRange(n, "chunk").write.mode("overwrite").json(f"{path}/feed")
    return n


def q_stream_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part-lead cascade run as a stream of chunks (a quarter of the input each); equals the batch result."""
    from ..sources import fixtures as fx

    base = checkpoint_dir_or_local(spark)
    run_dir = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    leads = fx.part_leads(spark, sf_dir)
    stage_leads(leads, f"{run_dir}/in", -(-leads.count() // 4))
    run_chunked(spark, f"{run_dir}/in", f"{run_dir}/out", f"{run_dir}/chk", fx.rules(spark),
                fx.brands(spark, sf_dir), descriptions=fx.part_descriptions(spark, sf_dir))
    out = results_so_far(spark, f"{run_dir}/out", RESULT_SCHEMA).drop("chunk")
    return out.withColumn("score", F.round("score", 6))
