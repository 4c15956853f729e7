"""Description stage (J7) and the describer request rows.

The reference asks an external model for a free-text description of the item. Here the
describer is either a description table joined on the text, or a user callable applied
per partition through ``mapInPandas``; with neither, every request gets null (the
reference's behaviour when no describer is configured). Answers of the callable go to a journal in small committed batches, so
what was answered is never asked again: a lost executor repeats the requests of its tasks in one batch at most, and a
restart with the same journal asks only what it lacks.
"""

from __future__ import annotations

import time
import uuid
from typing import Callable

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ellipsize, strip, text_key
from ..params import DEFAULT_PARAMS, Params
from ..plans.committed import CommittedSink
from ..session import checkpoint_dir_or_local, materialized, ship_package

ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("description", T.StringType())])


def _clean(desc) -> F.Column:
    s = strip(desc)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def answered(texts: DataFrame, provider: Callable[[str], str | None], params: Params = DEFAULT_PARAMS) -> DataFrame:
    """(text, description) for the distinct ``texts`` (text) that the provider answers, "no description" included; a call that raises is
    repeated up to ``provider_retries`` times after a bounded wait and then left out. Answers are journaled under ``answer_journal`` (a folder of
    their own if empty) in batches of about ``provider_batch`` texts, and texts that it holds are not asked."""
    spark = texts.sparkSession
    ship_package(spark)
    journal = CommittedSink(spark, params.answer_journal or f"{checkpoint_dir_or_local(spark).rstrip('/')}/answers-{uuid.uuid4().hex}")
    retries, wait, longest = params.provider_retries, params.provider_wait, params.provider_max_wait

    def ask(t: str):
        for turn in range(retries + 1):
            try:
                v = provider(t)
                return True, None if v is None else str(v)
            except Exception:  # noqa: BLE001 - a call that fails for good is "no description"
                if turn < retries:
                    time.sleep(min(longest, wait * 2 ** turn))
        return False, None

    def call(batches):
        for pdf in batches:
            got = [(t, *ask(t)) for t in pdf["text"]]
            yield pd.DataFrame([(t, v) for t, ok, v in got if ok], columns=["text", "description"], dtype=object)

    known = journal.read(ANSWER).select(F.col("text").alias("_known"))
    todo = materialized(texts.select("text").distinct().join(known, F.col("text") == F.col("_known"), "left_anti"))
    batches = -(-todo.count() // max(1, params.provider_batch))
    run = uuid.uuid4().hex
    for k in range(batches):
        part = todo.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == k)
        if params.provider_tasks > 0:  # bound the concurrent calls to a rate-limited service
            part = part.repartition(params.provider_tasks)
        journal.append(part.mapInPandas(call, ANSWER), f"{run}-{k}")
    return journal.read(ANSWER).select("text", "description")


def describe(requests: DataFrame, text_col: str, descriptions: DataFrame | None = None,
             provider: Callable[[str], str | None] | None = None, active=None,
             params: Params = DEFAULT_PARAMS, key_col: str | None = None) -> DataFrame:
    """``requests`` plus ``description`` (stripped; blank, missing or failed -> null).

    ``descriptions`` has columns ``text, description`` with one row per text; the join is a
    plain equi-join (AQE broadcasts it at run time when the table is small). ``active``
    (a boolean Column) limits which rows are described; the others get null and the
    provider is not called for them. Each distinct text is asked once (``answered``). ``key_col``: the ``text_key`` of the
    text, by which a table is joined; only a provider needs the text itself.
    """
    act = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    if descriptions is not None:
        # one description per text (deterministic if a table repeats a text), so the join never
        # multiplies result rows
        d = (descriptions.groupBy(F.col("text").alias("_dkey"))
             .agg(F.max(_clean(F.col("description"))).alias("_desc")))
        same = requests[text_col] == d["_dkey"] if key_col is None else requests[key_col] == text_key(d["_dkey"])
        out = requests.join(d, same, "left")
        return out.select(*requests.columns, F.when(act, _clean(F.col("_desc"))).alias("description"))
    if provider is not None:
        rows = materialized(requests.withColumn("_act", act))  # read twice below; what made them runs once
        answers = answered(rows.where("_act").select(F.col(text_col).alias("text")), provider, params)
        # a journal can hold a text twice if two runs asked at once: one answer counts
        answers = answers.groupBy(F.col("text").alias("_dkey")).agg(F.max(_clean(F.col("description"))).alias("_desc"))
        out = rows.join(answers, (F.col(text_col) == F.col("_dkey")) & F.col("_act"), "left")
        return out.select(*requests.columns, F.col("_desc").alias("description"))
    return requests.withColumn("description", F.lit(None).cast("string"))


def fallback_requests(below_gate: DataFrame, text_col: str, score_text_col: str, hint: str,
                      threshold: float) -> DataFrame:
    """What is sent to the describer for each below-gate text."""
    return below_gate.select(
        F.col(text_col).alias("text"),
        F.lit(hint).alias("reference_keywords"),
        F.lit(float(threshold)).alias("similarity_threshold"),
        F.col(score_text_col).cast("double").alias("similarity_score"),
        ellipsize(F.col(text_col), 50).alias("item"),
    )
