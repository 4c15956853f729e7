"""Inputs derived from the driver tables in ``/root/testdata/sf*/`` (FIXTURES.md, section B).

Every frame here is read from the parquet tables, so its size grows with the scale
factor; the only literals are the five-rule table and the four description phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import RULE_SCHEMA

# The five-rule fixture, (rule_idx, g1, g2, g5, must_not).
RULE_FIXTURE = (
    (0, ["red"], [], [], []),
    (1, [], ["blue", "rod"], [], []),
    (2, [], [], ["anvil", "ring"], ["old"]),
    (3, ["cold"], ["hot"], ["plate", "gear"], []),
    (4, [], [], [], ["x"]),
)

# Description fixture over part names (p_name -> description; None = null).
DESCRIPTION_FIXTURE = (
    ("new gizmo", "red gizmo kit"),
    ("small bolt", "a small bolt"),
    ("large widget", "未匹配到"),
    ("new widget", None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(spark: SparkSession) -> DataFrame:
    """The five literal rules: level1 = L{idx % 3}, code = 100 + idx, atomic = A{idx}."""
    rows = [(i, f"L{i % 3}", str(100 + i), f"A{i}", i + 1, g1, g2, [], [], g5, no)
            for i, g1, g2, g5, no in RULE_FIXTURE]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_sql() -> str:
    """The same rule table as a DuckDB ``VALUES`` list (for oracle SQL)."""
    def arr(xs):
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = [f"({i}::BIGINT, 'L{i % 3}', '{100 + i}', 'A{i}', {i + 1}::BIGINT, {arr(g1)}, {arr(g2)}, "
            f"{arr([])}, {arr([])}, {arr(g5)}, {arr(no)})" for i, g1, g2, g5, no in RULE_FIXTURE]
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(rule_idx, level1, code, atomic, sequence_no, "
            "g1, g2, g3, g4, g5, must_not)")


def _grown_name():
    """Part names, of which there are 64 at every scale; every fourth carries its key, so that
    distinct names grow with the table."""
    return F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))


def part_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads from ``part``: many duplicate names, a quarter of them distinct."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("lead_idx"), F.col("p_partkey").cast("string").alias("lead_code"),
        _grown_name().alias("lead_name"), F.lit(None).cast("array<float>").alias("embedding"))


def document_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long leads from ``documents`` (whole texts, four languages)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("lead_idx"), F.col("doc_id").cast("string").alias("lead_code"),
        F.col("text").alias("lead_name"))


def ascii_document_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without their non-ASCII characters (the SQL oracle compares bytes)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("lead_idx"), F.col("doc_id").cast("string").alias("lead_code"),
        F.regexp_replace("text", r"[^\x00-\x7F]", "").alias("lead_name"), F.lit(None).cast("array<float>").alias("embedding"))


def _named_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with a unique name: the part's name of that key (``item`` if there is none) and the id."""
    emb, parts = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (emb.join(parts, emb.vec_id == parts.p_partkey, "left").withColumn("p_name", F.coalesce("p_name", F.lit("item")))
            .select("vec_id", "label", "embedding", "p_name",
                    F.concat_ws(" ", "p_name", F.col("vec_id").cast("string")).alias("name")))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified brands: embeddings with odd vec_id."""
    return (_named_vectors(spark, sf_dir).where(F.pmod("vec_id", F.lit(2)) == 1)
            .select(F.col("vec_id").alias("brand_idx"), F.col("vec_id").cast("string").alias("brand_code"),
                    F.col("name").alias("brand_name"), F.lit("").alias("brand_keywords"),
                    F.concat(F.lit("cat_"), F.col("label").cast("string")).alias("atomic"),
                    F.col("embedding")))


def vector_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity texts: every vector (odd ids are exact brand hits)."""
    return _named_vectors(spark, sf_dir).select(
        F.col("vec_id").alias("lead_idx"), F.col("vec_id").cast("string").alias("lead_code"),
        F.col("name").alias("lead_name"), F.col("embedding"), F.col("p_name"), F.col("label"))


def _description_case(name_col):
    expr = None
    for name, desc in DESCRIPTION_FIXTURE:
        val = F.lit(desc) if desc is not None else F.lit(None).cast("string")
        expr = (F.when(name_col == name, val) if expr is None else expr.when(name_col == name, val))
    return expr


def part_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions keyed by part name: one row per distinct fixture name present in ``part``."""
    names = [n for n, _ in DESCRIPTION_FIXTURE]
    return (table(spark, sf_dir, "part").where(F.col("p_name").isin(names))
            .select(F.col("p_name").alias("text")).distinct()
            .select("text", _description_case(F.col("text")).alias("description")))


def vector_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions keyed by similarity-text name, by the part name it was built from."""
    names = [n for n, _ in DESCRIPTION_FIXTURE]
    return (vector_leads(spark, sf_dir).where(F.col("p_name").isin(names))
            .select(F.col("lead_name").alias("text"), _description_case(F.col("p_name")).alias("description")))


def description_case_sql(col: str) -> str:
    parts = []
    for name, desc in DESCRIPTION_FIXTURE:
        parts.append(f"WHEN {col} = '{name}' THEN " + ("NULL" if desc is None else f"'{desc}'"))
    return "CASE " + " ".join(parts) + " END"


def description_names_sql() -> str:
    return "(" + ", ".join(f"'{n}'" for n, _ in DESCRIPTION_FIXTURE) + ")"


def vector_leads_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity texts where every vector of label 9 lost its last value (a corrupt feed):
    those rows cannot be scored and must come out as error rows, the rest unaffected."""
    cut = F.slice("embedding", 1, F.size("embedding") - 1)
    return vector_leads(spark, sf_dir).withColumn(
        "embedding", F.when(F.col("label") == 9, cut).otherwise(F.col("embedding")))


def literal_rules(spark: SparkSession) -> DataFrame:
    """Rules whose keywords and categories look like variables, quotes and escapes."""
    rows = [(i, l1, code, atomic, i + 1, list(g1), [], [], [], list(g5), list(no)) for i, (l1, code, atomic, g1, g5, no) in enumerate(LITERAL_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


#: level1, code, atomic, all-of group, any-of group, must-not group.
LITERAL_RULES = (
    ("${env:HOME}", "${system:user.dir}", "a'b", ("${spark.app.name}",), (), ()),
    ("back\\slash", "1", "q\"q", (), ("${env:HOME}", "it's"), ("\\n",)),
    ("plain", "2", "%_", ("red", "$1"), (), ()),
    ("plain", "3", "taxonspark", ("taxonspark",), (), ()),
    ("plain", "4", "/root", (), ("/root", "small"), ("it's",)),
)
#: what part names are followed by, by key
LITERAL_TAILS = (" ${spark.app.name}", " it's", " it's \\n", " $1", " ${env:HOME}", "", " taxonspark")


def literal_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, LITERAL_TAILS)), (F.pmod("p_partkey", F.lit(len(LITERAL_TAILS))) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lead_idx"), F.concat("p_name", tail).alias("lead_name"))


HOT_NAME = "red rod"  # every first line item carries this name: one key holds about a quarter of all rows


def lineitem_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads from ``lineitem`` (600k rows at sf0.1) named after their part, except that every
    first line carries the same name — a hot key holding about a quarter of the rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(parts, li.l_partkey == parts.p_partkey, "left")
    name = F.when(F.col("l_linenumber") == 1, F.lit(HOT_NAME)).otherwise(F.coalesce(F.col("p_name"), F.lit("")))
    return j.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lead_idx"),
                    F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("lead_code"),
                    name.alias("lead_name"), F.lit(None).cast("array<float>").alias("embedding"))
