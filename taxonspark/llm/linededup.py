"""Site-relative line deduplication: drop the lines that many pages of one host share.

A line (trimmed, not blank) is boilerplate of a host if more than ``ratio`` of the host's pages, and
at least ``min_pages`` of them, contain it. Counting is done on 64-bit line hashes (pre-aggregated, so
neither a hot host nor a hot line meets in one task); the few lines that pass are counted again by
their text, which makes the result exact. One host has at most (lines of a page) / ratio such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_broadcast, staged


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(pages: DataFrame, *, ratio: float, min_pages: int) -> DataFrame:
    """(_host, line) of ``pages`` (_host, _t): the lines that are boilerplate of their host."""
    pages = pages.where("_host is not null")
    totals = staged(pages.groupBy("_host").agg(F.count("*").alias("pages")), "hosts")
    lines = F.array_distinct(F.transform(F.split("_t", "\n"), _trimmed))
    frequent = (F.col("n") >= min_pages) & (F.col("n") > ratio * F.col("pages"))

    def over(counted: DataFrame) -> DataFrame:
        return counted.join(small_broadcast(totals, 100_000), "_host").where(frequent)

    hashed = pages.select("_host", F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("h"))
    some = staged(over(hashed.groupBy("_host", "h").agg(F.count("*").alias("n"))).select("_host", "h"), "lines")
    texts = pages.select("_host", F.explode(lines).alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))
    exact = texts.join(small_broadcast(some, 200_000), ["_host", "h"], "left_semi").groupBy("_host", "line").agg(F.count("*").alias("n"))
    return staged(over(exact).select("_host", "line"), "boilerplate")


def drop_boilerplate(docs: DataFrame, *, host: Column | str = "source", text: str = "text", ratio: float = 0.1,
                     min_pages: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all of ``docs`` if None; ``text`` cleaned), then n_lines and n_dropped (long).

    Every row stays, in whatever order. A null host has no boilerplate, a null text stays null with
    0 lines, blank lines stay, repeated rows count as pages of their own; a text whose lines all go
    becomes empty; an empty table gives no rows. Other columns pass through untouched, also
    when their names are those used here, but for n_lines and n_dropped, which are replaced."""
    host = F.col(host) if isinstance(host, str) else host
    row = F.struct(*(F.col(c) for c in (keep or docs.columns) if c not in ("n_lines", "n_dropped")))
    rows = docs.select(row.alias("_row"), host.alias("_host"), F.col(text).alias("_t"))
    found = boilerplate(docs.select(host.alias("_host"), F.col(text).alias("_t")), ratio=ratio, min_pages=min_pages)
    by_host = staged(found.groupBy(F.col("_host").alias("_k")).agg(F.collect_set("line").alias("_drop")), "by-host")
    joined = rows.join(small_broadcast(by_host, 10_000), F.col("_host") == F.col("_k"), "left")
    lines = F.split("_t", "\n")
    kept = F.when(F.col("_drop").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), _trimmed(x))))
    out = joined.select("_row", kept.alias("_kept"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), "_t")
    out = out.withColumn("n_dropped", F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    cols = [F.array_join("_kept", "\n").alias(text) if c == text else F.col(f"_row.`{c}`") for c in out.schema["_row"].dataType.names]
    return out.withColumn("n_lines", F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long")).select(
        *cols, "n_lines", "n_dropped")


SQL = r"""
WITH l AS (SELECT doc_id, source, list_distinct([trim(x, E' \t\r') for x in string_split(text, E'\n')]) AS ls FROM documents WHERE source IS NOT NULL),
t AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT source, x, count(*) AS n FROM (SELECT source, unnest(ls) AS x FROM l) WHERE x <> '' GROUP BY source, x),
b AS (SELECT source, list(x) AS xs FROM c JOIN t USING (source) WHERE n >= 3 AND n > CAST(0.1 AS DOUBLE) * pages GROUP BY source),
k AS (SELECT doc_id, text, string_split(text, E'\n') AS ls, coalesce(xs, []) AS xs FROM documents LEFT JOIN b USING (source))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string([x for x in ls if not list_contains(xs, trim(x, E' \t\r'))], E'\n') END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len([x for x in ls if not list_contains(xs, trim(x, E' \t\r'))]) END AS BIGINT) AS n_dropped
FROM k
"""
