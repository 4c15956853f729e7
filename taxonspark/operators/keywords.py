"""Reference-keyword examples from the rule table (A4) and the hint string (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import HINT_SEPARATOR


def keyword_top_n(rules: DataFrame, n: int) -> DataFrame:
    """A4: scan rules in order, per rule atomic first then groups 1-5; strip, drop blanks,
    first occurrence wins; the first ``n`` distinct words -> ``(pos bigint, keyword)``.

    Distributed: ``posexplode`` per rule, ``min`` position per word (partial aggregation),
    then a top-n by position (the limit is the feature).
    """
    words = F.concat(F.array(F.col("atomic")), F.col("g1"), F.col("g2"), F.col("g3"), F.col("g4"), F.col("g5"))
    exploded = rules.select("rule_idx", F.posexplode(words).alias("p", "w"))
    cleaned = exploded.select("rule_idx", "p", strip(F.col("w")).alias("keyword")).where(F.col("keyword") != "")
    first = cleaned.groupBy("keyword").agg(F.min(F.struct("rule_idx", "p")).alias("o"))
    ranked = first.orderBy(F.col("o.rule_idx"), F.col("o.p")).limit(n)
    return ranked.select(F.col("keyword"), F.col("o.rule_idx").alias("rule_idx"), F.col("o.p").cast("bigint").alias("p"))


def keyword_hint(rules: DataFrame, n: int, max_chars: int) -> DataFrame:
    """A5 as a one-row DataFrame ``(hint string)``."""
    top = keyword_top_n(rules, n)
    joined = top.agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rule_idx"), F.col("p"), F.col("keyword")))),
                    lambda x: x["keyword"]), HINT_SEPARATOR).alias("full"))
    cut = F.substring(F.col("full"), 1, max_chars)
    short = F.when(F.instr(cut, HINT_SEPARATOR) > 0, F.regexp_replace(cut, f"{HINT_SEPARATOR}[^{HINT_SEPARATOR}]*$", "")) \
        .otherwise(cut)
    return joined.select(F.when(F.length("full") <= max_chars, F.col("full")).otherwise(short).alias("hint"))


def keyword_hint_text(rules: DataFrame, n: int, max_chars: int) -> str:
    """The hint as a driver-side string (a single bounded row: at most ``max_chars`` chars)."""
    row = keyword_hint(rules, n, max_chars).first()
    return (row["hint"] or "") if row else ""
