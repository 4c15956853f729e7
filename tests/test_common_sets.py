"""Hit sets of many texts against many rules: same rows as the compiled plan, categories made last."""

import pytest
from pyspark.sql import functions as F

from taxonspark.operators import rules as R
from taxonspark.operators import similarity as S
from taxonspark.operators.rules import RULE_SCHEMA, match_rules, rules_left
from taxonspark.params import DEFAULT_PARAMS as P
from taxonspark.plans.cascade import cascade
from taxonspark.session import WIDE_ROWS

ANCHOR = P.with_(rule_plan="anchor")


@pytest.fixture
def leads(spark):
    names = [("red rod", 9), ("red", 5), ("blue", 3), ("green", 1), ("", 1), (None, 2)]
    rows = [(i, f"c{i}", n) for i, n in enumerate(n for n, k in names for _ in range(k))]
    return spark.createDataFrame(rows, "lead_idx long, lead_code string, lead_name string")


@pytest.fixture
def rules(spark):
    rows = [(i, f"L{i}", str(i), f"A{i}", i, ["red"] if i % 2 else ["rod", "red"], [], [], [], [], ["blue"] if i == 3 else []) for i in range(40)]
    return spark.createDataFrame([*rows, (40, "L", "40", "A", 40, [], [], [], [], ["blue", "green"], ["green"])], RULE_SCHEMA)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_common_sets_in_pieces(leads, rules, monkeypatch):
    for name, n in (("COMMON", 2), ("PIECE", 2), ("PACKED", 7)):
        monkeypatch.setattr(R, name, n, raising=False)
    dealt = []
    if hasattr(R, "_met"):
        met = R._met
        monkeypatch.setattr(R, "_met", lambda rows, per_set, common: dealt.append({r["_k"] for r in common.collect()}) or met(rows, per_set, common))
    assert _rows(match_rules(leads, rules, "lead_name", ["lead_idx"], ANCHOR)) == _rows(match_rules(leads, rules, "lead_name", ["lead_idx"], P))
    out = ["lead_idx", "level1", "code", "atomic", "n_rules"]
    left = rules_left(leads, rules, "lead_name", ["lead_idx"], ANCHOR)
    assert _rows(left.select(out)) == _rows(rules_left(leads, rules, "lead_name", None, P).select(out))
    # the nine texts of one set are five pieces, none is one task
    assert len(dealt) == 2 and all(5 in k for k in dealt)


def test_cascade_joins_categories_last(spark, leads, rules, monkeypatch):
    brands = spark.createDataFrame([(1, "b1", "red rods", "", "X", [1.0, 0.0]), (2, "b2", "greens", "", "Y", None)], S.BRAND_SCHEMA)
    descriptions = spark.createDataFrame([("green", "a red thing"), ("blue", None)], "text string, description string")
    longest = []
    kept = S.materialized

    def watched(df):
        cols = [c for c in ("r_level1", "r_code", "r_atomic") if c in df.columns]
        out = kept(df)
        if cols:
            longest.append(out.agg(F.max(F.length(F.concat(*cols)))).first()[0])
        return out

    monkeypatch.setattr(S, "materialized", watched)
    got = _rows(cascade(leads, rules, brands, descriptions, params=ANCHOR))
    assert longest and max(x or 0 for x in longest) == 0
    assert got == _rows(cascade(leads, rules, brands, descriptions, params=P))
    assert any("L1；L3" in (r[3] or "") for r in got)


def test_texts_of_a_rule_follow_each_other(leads, rules, monkeypatch):
    """Matches of a common set come rule by rule, not text by text, so that files keep them in little room."""
    for name, n in (("COMMON", 2), ("PIECE", 16), ("TOGETHER", 16)):
        monkeypatch.setattr(R, name, n, raising=False)
    out = match_rules(leads, rules, "lead_name", ["lead_idx"], ANCHOR)
    rows = out.select("lead_idx", "rule_idx", F.spark_partition_id().alias("p")).collect()
    changes = sum(a.rule_idx != b.rule_idx for a, b in zip(rows, rows[1:]) if a.p == b.p)
    assert len(rows) > 400 and changes < len(rows) / 3
    keys = match_rules(leads, rules, "lead_name", ["lead_name", "lead_code"], ANCHOR)
    assert _rows(keys) == _rows(match_rules(leads, rules, "lead_name", ["lead_name", "lead_code"], P))


def test_categories_are_made_by_parts(spark, rules, leads, monkeypatch):
    """A set's rules are collapsed some at a time: same strings, no list of all of them; the writer of wide rows looks at its buffers often."""
    monkeypatch.setattr(R, "PART_BITS", 2)
    rows = [(k % 2, i, ("", f"L{i}", " L ", "　")[i % 4], "" if i % 8 > 2 else f"{i}", f"A{i % 3}") for k, i in enumerate([*range(-6, 30), 5, 5, 1 << 40])]
    rows += [(2, i, " ", "", "") for i in range(9)]
    hits = spark.createDataFrame(rows, "h1 long, rule_idx long, level1 string, code string, atomic string")
    assert _rows(R.collapse_by_parts(hits, ["h1"], "x_")) == _rows(R.collapse_matches(hits, ["h1"], "x_"))
    for k in WIDE_ROWS:
        spark.conf.unset(k)
    longest, collapsed = [], R._collapsed
    monkeypatch.setattr(R, "_collapsed", lambda g, *x: longest.append(g.agg(F.max(F.size("_m"))).first()[0]) or collapsed(g, *x))
    out = ["lead_idx", "level1", "code", "atomic", "n_rules"]
    got = _rows(rules_left(leads, rules, "lead_name", ["lead_idx"], ANCHOR).select(out))
    assert longest == [4] and got == _rows(rules_left(leads, rules, "lead_name", None, P).select(out))
    assert int(spark.conf.get("parquet.page.size.row.check.min")) < 10
    for k in WIDE_ROWS:
        spark.conf.unset(k)
