"""The three-stage cascade (C1-C4, J7-J9): rules, then nearest brand, then description.

Plan shape:

1. ``names``: distinct ``(stripped text, vector)`` with partial aggregation, so a hot
   text collapses map-side before the shuffle (J9 dedupe).
2. Rules: a compiled projection, or the anchor plan for large rule tables.
3. The rows are written once; those without a rule go to the top-1 brand kernel (broadcast or
   grid plan), the decided ones pass it by.
4. Below the gate: description join or provider (each request once), rules again over the
   description, and one ``select`` that decides.
5. One row per text is re-attached to every lead (duplicates included) with an equi-join on
   ``(text, vector hash)``; AQE splits a hot text's partition (skew join). Long texts are joined by their digest (``text_key``)
   and stay behind once the kernel has seen them.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, text_key
from ..operators.describe import describe
from ..operators.encode import encode_missing
from ..operators.rules import RuleIndex, prepare_rules, rules_left, rules_met, with_set_matches
from ..operators.similarity import match_by_similarity
from ..params import (DEFAULT_PARAMS, EMPTY_DESCRIPTION, METHOD_ERROR, METHOD_NONE, METHOD_NOT_FOUND,
                      METHOD_RULE, METHOD_SEARCH_MATCHED, METHOD_SEARCH_UNMATCHED, METHOD_SIMILARITY,
                      RESULT_COLUMNS, Params)
from ..session import materialized

KEYS = ["_t", "_vh"]


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def distinct_texts(leads: DataFrame, name_col: str = "lead_name", vec_col: str = "embedding") -> DataFrame:
    """J9 step 1: one row per (stripped text, vector); ``_vh`` is the vector's 64-bit hash."""
    v = F.col(vec_col).cast("array<float>") if vec_col in leads.columns else _null("array<float>")
    return (leads.select(strip(F.col(name_col)).alias("_t"), v.alias("_v"))
            .distinct()
            .withColumn("_vh", F.xxhash64("_v")))


def per_text_results(names: DataFrame, rules: DataFrame, brands: DataFrame | None,
                     descriptions: DataFrame | None = None,
                     provider: Callable[[str], str | None] | None = None,
                     params: Params = DEFAULT_PARAMS, encoder: Callable | None = None) -> DataFrame:
    """C1 over distinct texts: one row per ``(_t, _vh)`` with the cascade's decision.

    One linear chain, every stage a projection or a single operator over the previous one:
    rules (projection) -> nearest brand for rows without a rule (kernel; others pass
    through) -> description for rows below the gate (equi-join) -> rules over the
    description (projection) -> decision columns (one ``select`` of ``when`` chains).
    """
    return _with_categories(*_decided(names, rules, brands, descriptions, provider, params, encoder))


def _decided(names, rules, brands, descriptions, provider, params, encoder, key: str = "_t") -> tuple[DataFrame, list[DataFrame]]:
    """``per_text_results`` (with the column ``key`` of ``names``, the ``text_key`` unless it is the text itself, in place of the text), but a text matched by a large rule table has the id ``m_set`` of its matches instead of their categories;
    and these matches (none for a compiled table). Thousands of matching rules make categories of a megabyte a text: they are
    made once per set and joined by ``_with_categories`` as the last step."""
    rules = prepare_rules(rules, params)
    late, matches = isinstance(rules, RuleIndex), []

    def matched(texts, text_col, keys, prefix):
        if not late:
            return rules_left(texts, rules, text_col, keys, params, prefix=prefix)
        out, found = rules_met(texts, rules, text_col, keys or texts.columns, prefix)
        matches.append(found)
        return out.withColumns({prefix + c: F.lit("") for c in CATEGORIES})

    stage1 = matched(names, "_t", [*dict.fromkeys((key, "_t", "_vh", "_v"))], "r_")
    ruled = F.col("r_n_rules") > 0
    if brands is None:
        return stage1.select(key, "_vh", *_decide(ruled, None, params, late)), matches
    if encoder is not None:
        # every text that reaches the similarity stage and every brand gets a vector, as the reference
        # does (brands when they are loaded); the configured weight applies
        stage1 = encode_missing(stage1, "_t", "_v", encoder, active=~ruled, error_col="_v_error")
        if isinstance(brands, DataFrame):
            brands = materialized(encode_missing(brands, "brand_name", "embedding", encoder))
    else:
        stage1 = stage1.withColumn("_v_error", _null("string"))
    # a long text goes no further than to the kernel, unless a provider is to see it
    asked = provider is not None and descriptions is None
    carry = [*dict.fromkeys((key, *(["_t"] if asked else []), "_vh")), "r_level1", "r_code", "r_atomic", "r_n_rules", *(["r_set"] if late else []), "_v_error"]
    # a text that the encoder rejects is an error row of its own; the others go on (C4)
    sim = match_by_similarity(stage1, brands, [key, "_vh"], "_t", "_v", params,
                              active=~ruled & F.col("_v_error").isNull(), carry=carry)
    sim = sim.withColumn("error", F.coalesce("error", "_v_error")).drop("_v_error")
    low = (F.col("error").isNull() & F.col("brand_idx").isNotNull()
           & (F.col("score") < F.lit(float(params.fallback_threshold))))
    described = describe(sim, "_t", descriptions, provider, active=low, params=params, key_col=None if key == "_t" else key)
    d = matched(described, "description", None, "d_")
    return d.select(key, "_vh", *_decide(ruled, low, params, late)), matches


CATEGORIES = ("level1", "code", "atomic")


def _with_categories(rows: DataFrame, matches: list[DataFrame]) -> DataFrame:
    """``rows`` with the categories of the sets of matches that ``m_set`` names."""
    if not matches:
        return rows
    columns = [c for c in rows.columns if c != "m_set"]
    out = with_set_matches(rows, "m_set", matches, "_m_")
    return out.select(*[F.coalesce("_" + c, c).alias(c) if c in ("m_level1", "m_code", "m_atomic") else c for c in columns])


def _decide(ruled: Column, low: Column | None, params: Params, late: bool = False) -> list[Column]:
    """The cascade decision table as per-text columns (first applicable row wins); ``late``: with ``m_set``."""
    def pick(*cases, default):
        e = None
        for cond, val in cases:
            e = F.when(cond, val) if e is None else e.when(cond, val)
        return e.otherwise(default) if e is not None else default

    if low is None:
        return [F.col("r_n_rules").alias("m_n"), F.col("r_level1").alias("m_level1"),
                F.col("r_code").alias("m_code"), F.col("r_atomic").alias("m_atomic"),
                F.lit(False).alias("from_sim"), _null("bigint").alias("ref_idx"), _null("string").alias("ref_name"),
                _null("string").alias("ref_code"), _null("string").alias("ref_atomic"),
                _null("double").alias("score"), _null("string").alias("score_text"),
                _null("string").alias("llm_desc"), _null("string").alias("error"), *([F.col("r_set").alias("m_set")] if late else [])]
    err = ~ruled & F.col("error").isNotNull()
    hit = ~ruled & ~err & F.col("brand_idx").isNotNull()
    desc = F.col("description")
    aliases = list(params.unmatched_aliases)
    no_desc = hit & low & desc.isNull()
    alias = hit & low & desc.isin(aliases)
    rematch = hit & low & desc.isNotNull() & ~desc.isin(aliases) & (F.col("d_n_rules") > 0)
    from_sim = hit & ~rematch
    brand_atomic = F.coalesce(strip(F.col("brand_atomic")), F.lit(""))
    m_n = pick((ruled, F.col("r_n_rules")), (rematch, F.col("d_n_rules")), (hit, F.lit(1).cast("bigint")),
               default=F.lit(0).cast("bigint"))
    m_level1 = pick((ruled, F.col("r_level1")), (rematch, F.col("d_level1")), default=F.lit(""))
    m_code = pick((ruled, F.col("r_code")), (rematch, F.col("d_code")), default=F.lit(""))
    m_atomic = pick((ruled, F.col("r_atomic")), (rematch, F.col("d_atomic")), (hit, brand_atomic), default=F.lit(""))
    llm_desc = pick((no_desc, F.lit(EMPTY_DESCRIPTION)), (alias, F.lit(params.unmatched_marker)),
                    (hit & low, desc), default=_null("string"))

    def ref(c):
        return F.when(from_sim, F.col(c))

    return [m_n.alias("m_n"), m_level1.alias("m_level1"), m_code.alias("m_code"), m_atomic.alias("m_atomic"),
            from_sim.alias("from_sim"), ref("brand_idx").alias("ref_idx"), ref("brand_name").alias("ref_name"),
            ref("brand_code").alias("ref_code"), ref("brand_atomic").alias("ref_atomic"),
            ref("score").alias("score"), ref("score_text").alias("score_text"), llm_desc.alias("llm_desc"),
            F.when(err, F.col("error")).alias("error"),
            *([pick((ruled, F.col("r_set")), (rematch, F.col("d_set")), default=_null("string")).alias("m_set")] if late else [])]


def method_label(params: Params = DEFAULT_PARAMS) -> Column:
    """C2 (plus C4's error label) over the per-text columns."""
    desc = F.coalesce(F.col("llm_desc"), F.lit(""))
    return (F.when(F.col("error").isNotNull(), F.lit(METHOD_ERROR))
            .when(F.col("m_n") == 0, F.lit(METHOD_NONE))
            .when(desc == "", F.when(F.col("from_sim"), F.lit(METHOD_SIMILARITY)).otherwise(F.lit(METHOD_RULE)))
            .when(strip(desc).isin(list(params.unmatched_aliases)), F.lit(METHOD_NOT_FOUND))
            .when(~F.col("from_sim"), F.lit(METHOD_SEARCH_MATCHED))
            .otherwise(F.lit(METHOD_SEARCH_UNMATCHED)))


def result_columns(params: Params = DEFAULT_PARAMS) -> list[Column]:
    """C3 (and C4): the 11 result strings, from ``lead_code``, ``lead_name``, ``method`` and
    the per-text columns."""
    method = F.col("method")
    err = F.col("error").isNotNull()
    none = F.col("m_n") == 0
    blank_cats = method.isin(METHOD_NOT_FOUND, METHOD_SEARCH_UNMATCHED) | none | err
    has_ref = F.col("ref_idx").isNotNull() & ~none & ~err

    def cat(c):
        return F.when(blank_cats, F.lit("")).otherwise(F.col(c))

    def ref(c, stripped=True):
        v = strip(F.col(c)) if stripped else F.col(c)
        return F.when(has_ref, F.coalesce(v, F.lit(""))).otherwise(F.lit(""))

    desc = F.when(err, F.lit(METHOD_ERROR)).otherwise(F.coalesce(F.col("llm_desc"), F.lit("")))
    return [
        F.col("lead_code").alias("lead_code"),
        F.col("lead_name").alias("lead_name"),
        cat("m_level1").alias("level1"),
        cat("m_code").alias("code"),
        cat("m_atomic").alias("atomic"),
        method.alias("method"),
        ref("ref_name").alias("sim_brand"),
        ref("ref_code", stripped=False).alias("sim_code"),
        ref("ref_atomic").alias("sim_atomic"),
        F.when(has_ref & F.col("from_sim"), F.coalesce(F.col("score_text"), F.lit(""))).otherwise(F.lit(""))
        .alias("sim_score"),
        desc.alias("llm_desc"),
    ]


def reattach(leads: DataFrame, per_text: DataFrame, name_col: str = "lead_name",
             vec_col: str = "embedding") -> DataFrame:
    """J9 step 2: every lead (duplicates included) gets its text's result. ``per_text`` has the text (``_t``) or its key (``_tk``)."""
    v = F.col(vec_col).cast("array<float>") if vec_col in leads.columns else _null("array<float>")
    # the text crosses the shuffle once at most: the original name only travels where it isn't the key, and if it is asked for
    keyed = (leads.withColumn("_tk", text_key(strip(F.col(name_col)))).withColumn("_vh", F.xxhash64(v))
             .withColumn("_orig", F.when(F.col(name_col) != F.col("_tk"), F.col(name_col)))
             .drop(name_col))
    # null-safe, so that a lead without a name keeps its (unmatched) row
    right = per_text if "_tk" in per_text.columns else per_text.withColumn("_tk", text_key("_t")).drop("_t")
    right = right.withColumnsRenamed({"_tk": "_rt", "_vh": "_rvh"})
    return (keyed.join(right, F.col("_tk").eqNullSafe(F.col("_rt")) & (F.col("_vh") == F.col("_rvh")), "inner").drop("_rt", "_rvh")
            .withColumn(name_col, F.coalesce(F.col("_orig"), F.col("_tk"))).drop("_orig", "_tk"))


def cascade(leads: DataFrame, rules: DataFrame, brands: DataFrame | None,
            descriptions: DataFrame | None = None,
            provider: Callable[[str], str | None] | None = None,
            params: Params = DEFAULT_PARAMS, extra_cols: tuple[str, ...] = ("lead_idx",),
            encoder: Callable | None = None) -> DataFrame:
    """C1-C4 end to end: ``extra_cols`` + the 11 result columns + ``score`` (double) per lead.

    ``encoder`` (texts -> vectors) fills the missing vectors of texts and of brands, as the
    reference does with its embedding model."""
    names = distinct_texts(leads).withColumn("_tk", text_key("_t"))
    per_text, matches = _decided(names, rules, brands, descriptions, provider, params, encoder, "_tk")
    return attach_results(leads, per_text, params, extra_cols, matches)


def attach_results(leads: DataFrame, per_text: DataFrame, params: Params = DEFAULT_PARAMS, extra_cols: tuple[str, ...] = ("lead_idx",),
                   matches: list[DataFrame] = ()) -> DataFrame:
    """Every lead with the result row of its text. ``matches``: of ``_decided``, if ``per_text`` is."""
    joined = reattach(leads.select(*extra_cols, "lead_code", "lead_name",
                                   *(["embedding"] if "embedding" in leads.columns else [])), per_text)
    if matches:
        joined = _with_categories(joined.drop("embedding", "_vh"), matches)
    labelled = joined.withColumn("method", method_label(params))
    return labelled.select(*extra_cols, *result_columns(params),
                           F.when(F.col("from_sim") & (F.col("m_n") > 0), F.col("score")).alias("score"))


#: ``attach_results`` with its default columns
RESULT_SCHEMA = T.StructType([T.StructField("lead_idx", T.LongType()), *[T.StructField(c, T.StringType()) for c in RESULT_COLUMNS],
                              T.StructField("score", T.DoubleType())])


def results(leads: DataFrame, rules: DataFrame, brands: DataFrame | None, **kw) -> DataFrame:
    """Only the 11 reference columns (plus ``lead_idx`` for ordering)."""
    return cascade(leads, rules, brands, **kw).select("lead_idx", *RESULT_COLUMNS)
