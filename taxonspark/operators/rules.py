"""Keyword-rule matching (J1-J3) and multi-rule collapse (A1).

A rule row carries ``g1..g4`` (all-of groups), ``g5`` (any-of group) and ``must_not``.
A text matches when it is non-blank, contains no must-not word, contains one word of
``g5`` when ``g5`` is non-empty, contains every word of at least one non-empty group
among ``g1..g4`` when there is one, and at least one of ``g1..g5`` is non-empty.

Physical plans, same result:

* ``compiled``: rule tables of few keywords become one projection of ``contains`` tests, each
  predicate computed once per text (no join, no shuffle).
* ``broadcast``: broadcast nested-loop join with the (size-checked) rule table.
* ``anchor``: one Aho-Corasick pass per text finds the ids of the rule keywords it contains
  (linear in text length, independent of the rule count); dictionaries too large for one automaton are
  partitioned by q-grams instead (``operators/grams``). Distinct hit sets are joined with the
  rules on the rarest keyword of each rule alternative, and the predicate is re-checked as
  set algebra on ids, JVM-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WHITESPACE, join_nonblank
from ..session import expect_wide_rows, materialized, ship_package
from ..params import DEFAULT_PARAMS, JOIN_SEPARATOR, Params
from .grams import KeywordGrams

RULE_SCHEMA = T.StructType([
    T.StructField("rule_idx", T.LongType(), False),
    T.StructField("level1", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("atomic", T.StringType(), False),
    T.StructField("sequence_no", T.LongType(), False),
    *[T.StructField(g, T.ArrayType(T.StringType(), False), False)
      for g in ("g1", "g2", "g3", "g4", "g5", "must_not")],
])
GROUPS_ALL_OF = ("g1", "g2", "g3", "g4")
RULE_OUT = ("rule_idx", "level1", "code", "atomic")


def _rule_cols(cols: dict | None) -> dict:
    cols = dict(cols or {})
    for g in (*GROUPS_ALL_OF, "g5", "must_not"):
        cols.setdefault(g, F.col(g))
    return cols


def _groups_1_4(cols: dict | None = None) -> Column:
    c = _rule_cols(cols)
    return F.filter(F.array(*[c[g] for g in GROUPS_ALL_OF]), lambda g: F.size(g) > 0)


def rule_is_live(cols: dict | None = None) -> Column:
    """Rule-only part of J1: some keyword group is non-empty (must-not alone never matches)."""
    c = _rule_cols(cols)
    return (F.size(_groups_1_4(c)) > 0) | (F.size(c["g5"]) > 0)


def _predicate(has, cols: dict | None) -> Column:
    c = _rule_cols(cols)
    groups = _groups_1_4(c)
    return (rule_is_live(c)
            & ~F.exists(c["must_not"], has)
            & ((F.size(c["g5"]) == 0) | F.exists(c["g5"], has))
            & ((F.size(groups) == 0) | F.exists(groups, lambda g: F.forall(g, has))))


def rule_predicate(text, cols: dict | None = None) -> Column:
    """J1 with substring containment (case-sensitive). Rule columns default to the columns
    ``g1..g5, must_not`` in scope; ``cols`` may map any of them to other Columns (e.g. literals)."""
    t = F.col(text) if isinstance(text, str) else text
    return (t != "") & _predicate(lambda k: t.contains(k), cols)


def literal_rule(g1=(), g2=(), g3=(), g4=(), g5=(), must_not=()) -> dict:
    """Rule columns as array literals, for evaluating J1 as a plain projection."""
    def arr(xs):
        return F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return {"g1": arr(g1), "g2": arr(g2), "g3": arr(g3), "g4": arr(g4), "g5": arr(g5), "must_not": arr(must_not)}


def hit_set_predicate(hits, cols: dict | None = None) -> Column:
    """J1 evaluated on the set of rule keywords a text contains (anchor plan).

    Written with built-in array functions only (``arrays_overlap``, ``array_except``), no
    lambdas, so it is code-generated; arrays here never contain nulls."""
    h = F.col(hits) if isinstance(hits, str) else hits
    c = _rule_cols(cols)
    all_of = [(F.size(c[g]) > 0) & (F.size(F.array_except(c[g], h)) == 0) for g in GROUPS_ALL_OF]
    any_group = all_of[0] | all_of[1] | all_of[2] | all_of[3]
    n14 = F.size(c["g1"]) + F.size(c["g2"]) + F.size(c["g3"]) + F.size(c["g4"])
    return (((n14 > 0) | (F.size(c["g5"]) > 0))
            & ~F.arrays_overlap(c["must_not"], h)
            & ((F.size(c["g5"]) == 0) | F.arrays_overlap(c["g5"], h))
            & ((n14 == 0) | any_group))


def _rule_count_checked(rules: DataFrame, limit: int) -> int:
    n = rules.count()
    if n > limit:
        raise ValueError(f"rule table has {n} rows, above the broadcast bound {limit}")
    return n


def match_rules(texts: DataFrame, rules, text_col: str, keys: list[str] | str,
                params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Every (text, rule) pair that matches -> ``keys + rule_idx, level1, code, atomic``.

    ``text_col`` must already be stripped (the cascade strips once per distinct text). ``rules`` may be
    a ``RuleIndex`` or the rows of ``collect_rules``, prepared once for several runs.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if params.rule_plan not in ("auto", "literal", "broadcast", "anchor"):
        raise ValueError(f"unknown rule plan {params.rule_plan!r}")
    if params.rule_plan == "broadcast":
        return _match_broadcast(texts, rules, text_col, keys, params)
    rows = collect_rules(rules, params)
    if rows is None:
        return _match_anchor(texts, rules, text_col, keys, params)
    live = [r for r in rows if _is_live(r)]
    fields = _rule_table(live)
    return (texts.select(*keys, F.explode(matched_rules(text_col, live)).alias("_i"))
            .select(*keys, *[F.element_at(fields[c], F.col("_i")).alias(c) for c in RULE_OUT]))


def _match_broadcast(texts, rules, text_col, keys, params):
    if not isinstance(rules, DataFrame):
        raise ValueError("the broadcast plan takes the rule table itself")
    _rule_count_checked(rules, params.max_broadcast_rules)
    live = rules.where(rule_is_live())
    t = texts.select(*keys, F.col(text_col).alias("_t")).where(F.col("_t") != "")
    return (t.join(F.broadcast(live), rule_predicate("_t"), "inner")
            .select(*keys, *RULE_OUT))


# ----------------------------------------------------------------------------- anchor plan

_AUTOMATA: dict[str, object] = {}


def _automaton(token: str, words: list[tuple[str, int]]):
    a = _AUTOMATA.get(token)
    if a is None:
        a = ahocorasick.Automaton()
        for w, kid in words:
            a.add_word(w, kid)
        a.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[token] = a
    return a


def _hashed_with(seed: int):
    return lambda c: F.xxhash64(c, F.lit(seed))


class RuleIndex:
    """A large rule table prepared once: rules with keyword ids (64-bit hashes, checked to be unique) and the dictionary:
    broadcast if it has at most ``max_broadcast_keywords`` words, else partitioned by q-grams. Reusable across queries and
    micro-batches."""

    def __init__(self, rules: DataFrame, params: Params = DEFAULT_PARAMS):
        self.spark = rules.sparkSession
        groups = (*GROUPS_ALL_OF, "g5", "must_not")
        ship_package(self.spark)
        kw = materialized(rules.select(F.explode(F.concat(*groups)).alias("kw")).distinct())
        for seed in range(8):
            kid = _hashed_with(seed)
            n = kw.agg(F.count("*").alias("n"), F.countDistinct(kid("kw")).alias("d")).first()
            if n.n == n.d:
                break
        self.rules = materialized(rules.where(rule_is_live()).select(*RULE_OUT, *[F.transform(g, kid).alias(g) for g in groups]))
        self.n_words = n.n
        self.token = self.words = self.grams = None
        if self.n_words > params.max_broadcast_keywords:
            self.grams = KeywordGrams(kw.select(kid("kw").alias("kid"), "kw"))
        elif self.n_words:
            words = sorted((r.kw, r.kid) for r in kw.select("kw", kid("kw").alias("kid")).collect())
            self.token = hashlib.sha1("\x00".join(f"{w}\x01{k}" for w, k in words).encode("utf-8")).hexdigest()
            self.words = self.spark.sparkContext.broadcast(words)
        size = self.rules.agg(F.count("*").alias("n"), F.sum(sum((F.size(g) for g in groups), F.lit(0))).alias("k")).first()
        self.small = (size.n or 0) <= params.max_broadcast_rules and (size.k or 0) <= 8 * params.max_broadcast_rules

    def hint(self, df: DataFrame) -> DataFrame:
        """A table with at most some columns per rule keyword: broadcast only if the checked rule table is small."""
        return F.broadcast(df) if self.small else df


def keyword_hits(texts: DataFrame, text_col: str, keys: list[str], index: RuleIndex) -> DataFrame:
    """``keys + hits`` (sorted distinct ids of the rule keywords in each text), a row per row of ``texts``, repeated keys
    included. One linear pass over the texts."""
    none = F.array().cast("array<bigint>")
    if not index.n_words:  # no rule keyword at all: every hit set is empty
        return texts.select(*keys, none.alias("hits"))
    if index.grams is not None:
        rows = materialized(texts.select(F.struct(*keys).alias("keys"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()))
        sets = index.grams.hits(rows.select("row", "text").where("text != ''")).groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("kid")).alias("hits"))
        return rows.join(sets, F.col("row") == F.col("_row"), "left").select("keys.*", F.coalesce("hits", none).alias("hits"))

    token, words = index.token, index.words

    def scan(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(token, words.value)
        for s in series:
            yield pd.Series([sorted({k for _, k in auto.iter(t)}) if t else [] for t in s], dtype=object)

    # not deterministic for the planner only: a filter or projection over the hits must not scan the texts again
    hits = F.pandas_udf(scan, T.ArrayType(T.LongType(), False)).asNondeterministic()
    return texts.select(*keys, hits(F.col(text_col)).alias("hits"))


def rule_anchors(index: RuleIndex, sets: DataFrame) -> DataFrame:
    """``kid, rule_idx``: the keywords of which every match of a rule contains one. A rule with an any-of
    group and all-of groups takes the cheaper of (all any-of words) and (the rarest word of
    each all-of group), by how many of the hit ``sets`` contain them."""
    often = sets.select(F.explode("hits").alias("kid")).groupBy("kid").agg(F.count(F.lit(1)).alias("n"))
    parts = [index.rules.select("rule_idx", F.lit(i).alias("g"), F.explode(F.array_distinct(F.col(g))).alias("kid"))
             for i, g in enumerate((*GROUPS_ALL_OF, "g5"), start=1)]
    words = parts[0]
    for p in parts[1:]:
        words = words.unionByName(p)
    words = words.join(often, "kid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = words.where("g < 5").groupBy("rule_idx", "g").agg(F.min_by("kid", F.struct("n", "kid")).alias("kid"), F.min("n").alias("n"))
    both = rarest.select("rule_idx", F.lit(False).alias("any_of"), "kid", "n").unionByName(
        words.where("g = 5").select("rule_idx", F.lit(True).alias("any_of"), "kid", "n"))
    side = both.groupBy("rule_idx", "any_of").agg(F.sum("n").alias("cost"), F.collect_set("kid").alias("kids"))
    best = side.groupBy("rule_idx").agg(F.min_by("kids", F.struct("cost", "any_of")).alias("kids"))
    return best.select("rule_idx", F.explode("kids").alias("kid"))


def signature_matches(sets: DataFrame, index: RuleIndex) -> DataFrame:
    """``h1, h2`` and the rule (``RULE_OUT``) of each match of a distinct hit set (``h1, h2, hits``).

    J1 depends only on which rule keywords a text contains, so the rules are matched once per distinct
    hit set. Candidate pairs carry ids only; sets and rules are joined to them for the check."""
    sets = sets.select("h1", "h2", "hits")
    pairs = (sets.select("h1", "h2", F.explode("hits").alias("kid"))
             .join(index.hint(rule_anchors(index, sets)), "kid").select("h1", "h2", "rule_idx").distinct())
    full = pairs.join(index.hint(index.rules), "rule_idx").join(sets, ["h1", "h2"])
    return full.where(hit_set_predicate("hits")).select("h1", "h2", *RULE_OUT)


#: a hit set of more texts than ``COMMON`` is dealt over pieces of about ``PIECE`` texts, each with the set's rules once
COMMON, PIECE = 256, 2048
#: matched rules of a common set that travel as one row, and texts of a piece that meet them together
PACKED, TOGETHER = 1024, 256


def hit_sets(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``hits`` (``hits`` replaced by a 128-bit id ``h1, h2`` of the set, null where it is empty, and a number ``_n``), computed
    once, and the distinct sets with the number ``n`` of their rows."""
    some = F.size("hits") > 0
    h = materialized(hits.withColumn("_n", F.monotonically_increasing_id()).withColumn("h1", F.when(some, F.xxhash64("hits"))).withColumn("h2", F.when(some, F.xxhash64("hits", F.lit(1)))))
    sets = h.where("h1 is not null").groupBy("h1", "h2").agg(F.first("hits").alias("hits"), F.count(F.lit(1)).alias("n"))
    return h.drop("hits"), materialized(sets)


def _dealt(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``_k``, the number of pieces of their hit set (null unless it is common), and the common sets' ``h1, h2, _k``
    (None if there are none). A common set would else be one task, however many texts and rules meet in it."""
    common = sets.where(F.col("n") > COMMON).select("h1", "h2", F.ceil(F.col("n") / PIECE).cast("int").alias("_k"))
    n = common.count()
    if not n:
        return rows.withColumn("_k", F.lit(None).cast("int")), None
    return rows.join(F.broadcast(common) if n <= 100_000 else common, ["h1", "h2"], "left"), common


def _met(rows: DataFrame, per_set: DataFrame, common: DataFrame) -> DataFrame:
    """Rows of common hit sets (with their number ``_n`` or their ``_piece``) with what ``per_set`` (one or several rows per ``h1, h2``) says of
    their set, piece by piece."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = ["h1", "h2", "_piece"]
    # a fixed number of tasks: these rows are few bytes and much work, AQE would join them into a few
    if "_piece" not in rows.columns:
        rows = rows.withColumn("_piece", F.pmod("_n", F.col("_k")).cast("int"))
    left = rows.drop("_n", "_k").repartition(parts, *at)
    right = (per_set.join(common, ["h1", "h2"]).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
             .repartition(parts, *at))
    return left.join(right.hint("merge"), at).drop("_piece")


def _match_anchor(texts, rules, text_col, keys, params):
    index = rules if isinstance(rules, RuleIndex) else RuleIndex(rules, params)
    out = [*keys, *RULE_OUT]
    rows, sets = hit_sets(keyword_hits(texts.where(F.col(text_col) != ""), text_col, keys, index))
    rows, common = _dealt(rows, sets)
    found = rows.where("_k is null and h1 is not null").join(signature_matches(sets.where(F.col("n") <= COMMON), index), ["h1", "h2"]).select(*out)
    if common is None:
        return found
    matches = materialized(signature_matches(sets.where(F.col("n") > COMMON), index))
    size = matches.groupBy("h1", "h2").agg(F.ceil(F.count(F.lit(1)) / PACKED).alias("_lists"))
    packed = (matches.join(size, ["h1", "h2"]).groupBy("h1", "h2", F.pmod(F.xxhash64("rule_idx"), F.col("_lists")).alias("_list"))
              .agg(F.collect_list(F.struct(*RULE_OUT)).alias("_rules")).drop("_list"))
    # a rule's texts follow each other, the same texts for rule after rule: columnar files keep such rows in a fraction of a byte each,
    # while a text's rules, tens of thousands before they come again, take bytes each
    piece = F.pmod("_n", F.col("_k")).cast("int")
    part = F.pmod(F.expr("_n div _k"), F.lit(-(-PIECE // TOGETHER)))
    lists = (rows.where("_k is not null").groupBy("h1", "h2", piece.alias("_piece"), part.alias("_list"))
             .agg(F.collect_list(F.struct(*keys)).alias("_texts")))
    met = _met(lists.drop("_list"), packed, common).select("_texts", F.explode("_rules").alias("_rule"))
    often = met.select("_texts", *[F.col(f"_rule.{c}").alias(c) for c in RULE_OUT]).select(F.explode("_texts").alias("_text"), *RULE_OUT)
    return found.unionByName(often.select(*[F.col("_text").getField(c).alias(c) for c in keys], *RULE_OUT))


def with_collapsed(rows: DataFrame, sets: DataFrame, matches: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` (materialised; ``h1, h2`` of their hit set, or null, and a number ``_n``) with the collapsed ``matches`` (A1) of their set, null
    without a match. The strings are made once per set and meet the rows last: with thousands of matching rules they are larger than
    any text."""
    expect_wide_rows(rows.sparkSession)
    per_set = collapse_by_parts(matches, ["h1", "h2"], prefix)
    texts = [prefix + c for c in (*RULE_OUT[1:], "n_rules")]
    rows, common = _dealt(rows, sets)
    none = [F.lit(None).cast(per_set.schema[c].dataType).alias(c) for c in texts]
    kept = [c for c in rows.columns if c not in ("h1", "h2", "_n", "_k")]
    rest = per_set if common is None else per_set.join(common, ["h1", "h2"], "left_anti")
    out = (rows.where("_k is null and h1 is not null").join(rest, ["h1", "h2"], "left").select(*kept, *texts)
           .unionByName(rows.where("h1 is null").select(*kept, *none)))
    if common is None:
        return out
    # sets without a match get a row too, so that the join keeps their texts
    often = common.select("h1", "h2").join(per_set, ["h1", "h2"], "left")
    return out.unionByName(_met(rows.where("_k is not null"), often, common).select(*kept, *texts))


def _left_anchor(texts, rules, text_col, keys, params, prefix):
    """J3 for large rule tables: texts -> hit sets -> per-set collapsed matches, joined on the id of the set."""
    index = rules if isinstance(rules, RuleIndex) else RuleIndex(rules, params)
    rows, sets = hit_sets(keyword_hits(texts, text_col, keys, index))
    out = with_collapsed(rows, sets, signature_matches(sets, index), prefix)
    return out.select(
        *keys,
        *[F.coalesce(F.col(prefix + c), F.lit("")).alias(prefix + c) for c in ("level1", "code", "atomic")],
        F.coalesce(F.col(prefix + "n_rules"), F.lit(0).cast("bigint")).alias(prefix + "n_rules"),
    )


def rules_met(texts: DataFrame, index: RuleIndex, text_col: str, keys: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """J3 without its strings: ``keys``, ``set`` (the id of the text's hit set, null without a match) and ``n_rules``, and the
    ``matches`` (``set`` and the rule) of all sets, for ``with_set_matches``."""
    rows, sets = hit_sets(keyword_hits(texts, text_col, keys, index))
    matches = materialized(signature_matches(sets, index))
    n = matches.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_rules"))
    met = rows.join(n, ["h1", "h2"], "left").select(
        *keys, F.when(F.col("_rules") > 0, F.concat_ws(" ", "h1", "h2")).alias(prefix + "set"),
        F.coalesce("_rules", F.lit(0).cast("bigint")).alias(prefix + "n_rules"))
    return met, matches


def with_set_matches(rows: DataFrame, set_col: str, matches: list[DataFrame], prefix: str) -> DataFrame:
    """``rows`` with the collapsed matches of the sets that ``set_col`` names (null: none); ``matches`` as from ``rules_met`` of one index."""
    found = matches[0]
    for m in matches[1:]:  # a set's matches are the same in all of them
        found = found.unionByName(m.join(found.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti"))
    part = F.split(set_col, " ")
    rows = materialized(rows.withColumns({"h1": part[0].cast("bigint"), "h2": part[1].cast("bigint"), "_n": F.monotonically_increasing_id()}).drop(set_col))
    sets = materialized(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    return with_collapsed(rows, sets, found.join(sets.select("h1", "h2"), ["h1", "h2"], "left_semi"), prefix)


# ----------------------------------------------------------------------------- J3 / A1

def _ordered_matches(valid=None):
    st = F.struct(*RULE_OUT)
    if valid is not None:
        st = F.when(valid, st)
    return F.array_sort(F.collect_list(st))


def _collapsed(g: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return g.select(
        *keys,
        join_nonblank(F.transform("_m", lambda x: x["level1"]), JOIN_SEPARATOR).alias(prefix + "level1"),
        F.array_join(F.filter(F.transform("_m", lambda x: x["code"]), lambda c: c != ""),
                     JOIN_SEPARATOR).alias(prefix + "code"),
        join_nonblank(F.transform("_m", lambda x: x["atomic"]), JOIN_SEPARATOR).alias(prefix + "atomic"),
        F.size("_m").cast("bigint").alias(prefix + "n_rules"),
    )


def collapse_matches(hits: DataFrame, keys: list[str] | str, prefix: str = "") -> DataFrame:
    """A1: one row per key with level1/code/atomic joined by '；' in rule order.

    Blanks are dropped per column independently, duplicates kept; codes are not stripped.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _collapsed(hits.groupBy(*keys).agg(_ordered_matches().alias("_m")), keys, prefix)


#: bits of a rule's number that tell its place within a part
PART_BITS = 12


def collapse_by_parts(hits: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """``collapse_matches`` for keys of many rules: strings of up to 4,096 consecutive rule numbers are made first, by any task, and then
    joined in order; no task holds all matches of a key as rows."""
    part = F.shiftright("rule_idx", PART_BITS)
    made = _collapsed(hits.groupBy(*keys, part.alias("_part")).agg(_ordered_matches().alias("_m")), [*keys, "_part"], "")
    texts = RULE_OUT[1:]
    parts = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", *texts))).alias("_p"), F.sum("n_rules").alias("n_rules"))
    return parts.select(*keys, *[F.array_join(F.array_remove(F.col(f"_p.{c}"), ""), JOIN_SEPARATOR).alias(prefix + c) for c in texts],
                        F.col("n_rules").alias(prefix + "n_rules"))


def collect_rules(rules, params: Params = DEFAULT_PARAMS):
    """Rule tables of few keywords as driver-side rows (one bounded job), else None (use the anchor plan).

    A list of rows passes through unchanged, so a cascade collects its rules only once. The plan is
    chosen by the number of keywords, as the compiled plan tests each on every text."""
    if isinstance(rules, list):
        return rules
    if isinstance(rules, RuleIndex) or params.rule_plan == "anchor":
        return None
    forced = params.rule_plan in ("literal", "broadcast")
    limit = params.max_broadcast_rules if forced else params.max_compiled_rules
    rows = rules.limit(limit + 1).collect()
    if len(rows) > limit:
        if forced:
            raise ValueError(f"rule table has more than {limit} rows, above the literal-plan bound")
        return None
    words = sum(len(r[g]) for r in rows for g in (*GROUPS_ALL_OF, "g5", "must_not"))
    if not forced and words > params.max_compiled_keywords:
        return None
    return sorted(rows, key=lambda r: r["rule_idx"])


def prepare_rules(rules, params: Params = DEFAULT_PARAMS):
    """What several runs can share: the rows of a small rule table, or a ``RuleIndex``."""
    if isinstance(rules, RuleIndex):
        return rules
    rows = collect_rules(rules, params)
    return RuleIndex(rules, params) if rows is None else rows


def _is_live(rule) -> bool:
    return any(rule[g] for g in (*GROUPS_ALL_OF, "g5"))


def rule_column(text: str, rule) -> Column:
    """J1 for one known rule as a Column over ``contains``. Empty groups are dropped when it is built, so it
    has no higher-order functions and stays inside whole-stage codegen; keywords are literals, never
    SQL text."""
    t = F.col(text)

    def any_of(xs):
        out = F.lit(False)
        for x in xs:
            out = out | x
        return out

    def all_of(xs):
        out = F.lit(True)
        for x in xs:
            out = out & x
        return out

    has = lambda k: F.contains(t, F.lit(k))
    groups = [rule[g] for g in GROUPS_ALL_OF if rule[g]]
    parts = [t != ""]
    if rule["must_not"]:
        parts.append(~any_of([has(k) for k in rule["must_not"]]))
    if rule["g5"]:
        parts.append(any_of([has(k) for k in rule["g5"]]))
    if groups:
        parts.append(any_of([all_of([has(k) for k in g]) for g in groups]))
    return all_of(parts) if _is_live(rule) else F.lit(False)


def matched_rules(text: str, rows) -> Column:
    """The 1-based positions in ``rows`` of the rules that a text matches, in order; every predicate is
    computed once."""
    hits = [F.when(rule_column(text, r), F.lit(i)) for i, r in enumerate(rows, start=1)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def _rule_table(rows) -> dict[str, Column]:
    """The output fields of ``rows`` as literal arrays."""
    out = {"rule_idx": F.array(*[F.lit(int(r["rule_idx"])).cast("bigint") for r in rows])}
    for c in RULE_OUT[1:]:
        out[c] = F.array(*[F.lit(r[c] or "") for r in rows])
    return out


def _picker(values: Column):
    return lambda i: F.element_at(values, i)


def _compiled_left(texts: DataFrame, text: str, rows, prefix: str) -> DataFrame:
    """J3 + A1: all columns plus level1 / code / atomic joined by '；' in rule order (blanks dropped per
    column, codes not stripped) and ``n_rules``."""
    live = [r for r in rows if _is_live(r)]
    if not live:
        return texts.select("*", *[F.lit("").alias(prefix + c) for c in RULE_OUT[1:]], F.lit(0).cast("bigint").alias(prefix + "n_rules"))
    strip_py = lambda v: (v or "").strip(PY_WHITESPACE)
    kept = {"level1": strip_py, "code": lambda v: v or "", "atomic": strip_py}
    # a projection of its own, used several times below, so that it isn't computed again for each use
    found = texts.withColumn("_rules", matched_rules(text, live))
    joined = []
    for c, keep in kept.items():
        names = F.transform("_rules", _picker(F.array(*[F.lit(keep(r[c])) for r in live])))
        joined.append(F.coalesce(F.array_join(F.array_remove(names, ""), JOIN_SEPARATOR), F.lit("")).alias(prefix + c))
    return found.select(*texts.columns, *joined, F.coalesce(F.size("_rules"), F.lit(0)).cast("bigint").alias(prefix + "n_rules"))


def rules_left(texts: DataFrame, rules, text_col: str, keys: list[str] | str | None = None,
               params: Params = DEFAULT_PARAMS, prefix: str = "") -> DataFrame:
    """Every row of ``texts`` with its collapsed rule match (A1), or blanks and ``n_rules = 0``.

    Small rule tables (``collect_rules``) are compiled into the projection — no join, no
    shuffle, all columns of ``texts`` kept. Large ones go through the anchor join on the
    distinct texts, joined back on the text (``keys`` are kept). A null text matches nothing.
    """
    rows = collect_rules(rules, params)
    if rows is not None:
        return _compiled_left(texts, text_col, rows, prefix)
    keys = list(texts.columns) if keys is None else ([keys] if isinstance(keys, str) else list(keys))
    return _left_anchor(texts, rules, text_col, keys, params, prefix)
