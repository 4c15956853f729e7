import random

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from taxonspark.operators.rules import RULE_SCHEMA, RuleIndex, collect_rules, match_rules, rules_left
from taxonspark.params import Params
from taxonspark.plans import oracle


def rule(idx, g1=(), g2=(), g3=(), g4=(), g5=(), no=(), atomic=None, level1=None, code=None):
    return (idx, level1 if level1 is not None else f"L{idx}", code if code is not None else str(100 + idx),
            atomic if atomic is not None else f"A{idx}", 0, list(g1), list(g2), list(g3), list(g4), list(g5), list(no))


def expected(texts, rules):
    """The matches by the oracle's SQL in DuckDB: per text, the atomic names in rule order."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    con.execute("CREATE TABLE r(rule_idx BIGINT, atomic VARCHAR, g1 VARCHAR[], g2 VARCHAR[], g3 VARCHAR[], g4 VARCHAR[], g5 VARCHAR[], must_not VARCHAR[])")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(r[0], r[3], *r[5:11]) for r in rules])
    out = [[] for _ in texts]
    for i, atomic in con.execute(f"SELECT i, atomic FROM t JOIN r ON {oracle.pred(oracle.strip('t.t'), 'r.')} ORDER BY i, rule_idx").fetchall():
        out[i].append(atomic)
    return out


def run(spark, texts, rules, plan):
    tdf = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    rdf = spark.createDataFrame(rules, RULE_SCHEMA)
    rows = match_rules(tdf, rdf, "t", ["k"], Params(rule_plan=plan)).collect()
    out = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r["k"], r["rule_idx"])):
        out[r["k"]].append(r["atomic"])
    return [out[i] for i in range(len(texts))]


PLANS = ["literal", "broadcast", "anchor"]


def test_reference_cases(spark):
    for plan in PLANS:
        assert run(spark, ["", "  "], [rule(0, g1=["奶茶"])], plan) == [[], []]
        assert run(spark, ["奶茶店", "咖啡奶茶"], [rule(0, g1=["奶茶"], no=["咖啡"])], plan) == [["A0"], []]
        assert run(spark, ["奶茶茶饮", "奶茶"], [rule(0, g1=["奶茶", "茶饮"])], plan) == [["A0"], []]
        assert run(spark, ["a", "b", "x"], [rule(0, g1=["a"]), rule(1, g1=["b"])], plan) == [["A0"], ["A1"], []]


def test_group5_and_must_not_only(spark):
    rules = [rule(0, g5=["x", "y"]), rule(1, no=["z"]), rule(2, g2=["p"], g5=["q"])]
    texts = ["y", "zz", "p", "pq", "q", "　y　"]
    for plan in PLANS:
        assert run(spark, texts, rules, plan) == [["A0"], [], [], ["A2"], [], ["A0"]]


@settings(max_examples=15, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_plans_agree_with_sql(spark, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "ab", "奶", "茶", "c"]
    pick = lambda k: [rnd.choice(words) for _ in range(rnd.randint(0, k))]
    rules = [rule(i, pick(2), pick(2), pick(1), pick(1), pick(3), pick(1)) for i in range(rnd.randint(1, 8))]
    texts = ["".join(rnd.choice(words + [" "]) for _ in range(rnd.randint(0, 6))) for _ in range(25)]
    want = expected(texts, rules)
    for plan in PLANS:
        assert run(spark, texts, rules, plan) == want, plan


def test_collapse_keeps_order_duplicates_and_drops_blanks(spark):
    rules = [rule(0, g1=["a"], level1="L", atomic=" X "), rule(1, g1=["a"], level1=" ", code="", atomic="X"),
             rule(2, g1=["a"], level1="M", code=" 7 ", atomic="")]
    tdf = spark.createDataFrame([(1, "a")], "k long, t string")
    for plan in ("literal", "anchor"):
        r = rules_left(tdf, spark.createDataFrame(rules, RULE_SCHEMA), "t", ["k", "t"], Params(rule_plan=plan)).first()
        assert (r["level1"], r["code"], r["atomic"], r["n_rules"]) == ("L；M", "100； 7 ", "X；X", 3)


def test_special_characters_in_keywords(spark):
    rules = [rule(0, g1=["a'b", "c\\d"]), rule(1, g5=["x\ny", "%_"], no=["\\n"]), rule(2, g1=["$1", "``"])]
    texts = ["za'bc\\d", "x\ny", "100%_", "%_ \\n", "$1``", "a'b"]
    want = expected(texts, rules)
    assert want == [["A0"], ["A1"], ["A1"], [], ["A2"], []]
    for plan in PLANS:
        assert run(spark, texts, rules, plan) == want, plan


GRAMS = Params(rule_plan="anchor", max_broadcast_keywords=0)


def by_plan(spark, tdf, rules, params):
    rows = match_rules(tdf, spark.createDataFrame(rules, RULE_SCHEMA), "t", ["k"], params).collect()
    return sorted((r["k"], r["rule_idx"]) for r in rows)


def test_partitioned_dictionary_keeps_repeated_keys_apart(spark):
    """No match that only two texts of one key have together, and repeated rows as often as they come."""
    rules = [rule(0, g1=["red", "blue"]), rule(1, g1=["green"])]
    tdf = spark.createDataFrame([(1, "red x"), (1, "blue y"), (2, "green"), (2, "green")], "k long, t string")
    for params in (GRAMS, Params(rule_plan="anchor"), Params(rule_plan="literal")):
        assert by_plan(spark, tdf, rules, params) == [(2, 1), (2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_partitioned_dictionary_agrees(spark, seed):
    rnd = random.Random(seed)
    letters = "abc奶茶\U0001f375 é"
    pick = lambda k, n: ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, n))) for _ in range(rnd.randint(0, k))]
    rules = [rule(i, pick(2, 7), pick(2, 3), pick(1, 5), [], pick(3, 6), pick(1, 2)) for i in range(40)]
    tdf = spark.createDataFrame([(i % 30, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(5, None), (6, "")], "k long, t string")
    want = by_plan(spark, tdf, rules, Params(rule_plan="anchor"))
    assert by_plan(spark, tdf, rules, GRAMS) == want and want
    left = [sorted(map(str, rules_left(tdf, spark.createDataFrame(rules, RULE_SCHEMA), "t", ["k", "t"], p).collect())) for p in (GRAMS, Params(rule_plan="literal"))]
    assert left[0] == left[1]


def test_partitioned_dictionary_with_long_keywords(spark):
    long = "".join(f"{i} " for i in range(200))
    rules = [rule(0, g1=[long]), rule(1, g1=[long[:-2] + "!"]), rule(2, g5=[long[100:400], "zz" * 100]), rule(3, g1=["7"])]
    texts = [("x" * 500 + long * 2), long[:-3], long[90:410], "zz" * 99, "zz" * 150, "y" * 3000 + "7"]
    tdf = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = by_plan(spark, tdf, rules, Params(rule_plan="literal"))
    assert by_plan(spark, tdf, rules, GRAMS) == want == [(0, 0), (0, 2), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3), (4, 2), (5, 3)]


def test_partitioned_dictionary_shuffles_a_keyword_once_a_text(spark):
    """What the scan hands on grows with the keywords that a text has, not with the places where it has them."""
    from taxonspark.operators.grams import KeywordGrams, _scanner
    kw = spark.createDataFrame([(0, "a"), (1, "the"), (2, "heat"), (3, "theatre"), (4, "absent")], "kid long, kw string")
    index = KeywordGrams(kw)
    texts = spark.createDataFrame([(0, "the heat theatre a " * 5000), (1, "the"), (2, "")], "row long, text string")
    found = texts.mapInArrow(_scanner(index.filter, index.sizes), "row long, piece string")
    assert found.count() <= 8  # 5 real ones, and what only looks like one
    assert sorted(map(tuple, index.hits(texts).collect())) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1)]


def test_rule_table_without_keywords(spark):
    rules = [rule(0, no=["x"]), rule(1)]
    for plan in PLANS:
        assert run(spark, ["x", "abc", ""], rules, plan) == [[], [], []]


def test_keywords_are_never_expanded(spark):
    """Keywords and categories that look like variables, quotes or escapes stay as they are on every plan."""
    rules = [rule(0, g1=["${spark.app.name}"], level1="${env:HOME}", code="${system:user.dir}"), rule(1, g5=["${env:HOME}", "it's"], no=["\\"]),
             rule(2, g2=["{{x}}", "a\"b"], atomic="'${sql:x}'"), rule(3, g1=["taxonspark"]), rule(4, g1=["/root"])]
    texts = ["say ${spark.app.name}", "taxonspark", "/root", "${env:HOME}", "it's", "it's \\", "{{x}} a\"b"]
    want = expected(texts, rules)
    assert want == [["A0"], ["A3"], ["A4"], ["A1"], ["A1"], [], ["'${sql:x}'"]]
    for plan in ("auto", *PLANS):
        assert run(spark, texts, rules, plan) == want, plan
    tdf = spark.createDataFrame([(0, texts[0])], "k long, t string")
    for plan in ("auto", "anchor"):
        r = rules_left(tdf, spark.createDataFrame(rules, RULE_SCHEMA), "t", ["k", "t"], Params(rule_plan=plan)).first()
        assert (r["level1"], r["code"]) == ("${env:HOME}", "${system:user.dir}")


def test_auto_plan_by_keyword_count(spark):
    rules = [rule(i, g5=[f"w{i}x{k}" for k in range(40)]) for i in range(20)]
    texts = [f"a w{i}x{k}" for i in (0, 7, 19) for k in (0, 39)] + ["w3x"]
    assert collect_rules(spark.createDataFrame(rules, RULE_SCHEMA)) is None
    assert run(spark, texts, rules, "auto") == run(spark, texts, rules, "broadcast") == expected(texts, rules)


def test_rule_index_serves_several_runs(spark):
    rules = spark.createDataFrame([rule(0, g1=["a", "b"]), rule(1, g5=["c"], no=["x"])], RULE_SCHEMA)
    index = RuleIndex(rules)
    for texts in (["ab", "cx"], ["c", "b"]):
        tdf = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
        got = {(r["k"], r["rule_idx"]) for r in match_rules(tdf, index, "t", "k").collect()}
        assert got == ({(0, 0)} if texts[0] == "ab" else {(0, 1)})
