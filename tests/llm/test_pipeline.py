"""The pipeline's stages against brute force, and the guard in the entry module."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from taxonspark.llm.common import staged

from test_lines_spans import lines_by_hand
from test_text_joins import contaminated_by_hand, groups_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = staged(stage(spark, docs, sf), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_language_stage_keeps_texts_with_letters(stages):
    _, before, after = stages[0]
    want = sorted(r.doc_id for r in before.collect() if r.text is not None and any(c.isalpha() for c in r.text))
    assert sorted(r.doc_id for r in after.collect()) == want


def test_line_stage(stages):
    _, before, after = stages[1]
    want = [(d, t) for d, t, _, _ in lines_by_hand([(r.doc_id, r.text, r.source) for r in before.collect()], 0.1, 3)]
    got = [(r.doc_id, r.text) for r in after.collect()]
    assert sorted(got) == sorted(want) and all(r.n_chars == len(r.text) for r in after.collect())


def test_jaccard_stage(stages):
    _, before, after = stages[2]
    want = sorted(d for d, _, c in groups_by_hand([(r.doc_id, r.text) for r in before.collect()]) if d == c)
    assert sorted(r.doc_id for r in after.collect()) == want and len(want) < before.count()


def test_decontamination_stage(spark, sf, stages):
    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in contaminated_by_hand([(r.doc_id, r.text) for r in before.collect()], items) if not r[-1])
    assert sorted(r.doc_id for r in after.collect()) == want


def test_mixing_stage(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before.collect())
    assert all(r.rate >= 0 and r.copies >= 0 for r in rows)


def test_run_equals_the_stages(spark, sf, stages):
    want = {r.doc_id: round(r.rate, 3) for r in stages[-1][2].collect()}
    assert {r.doc_id: round(r.rate, 3) for r in pipeline.run(spark, sf).collect()} == want


def test_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some words are here", "en", "s", 19), (1, "some words are here", "en", "s", 19), (2, None, None, None, None), (3, "", "en", "s", 0),
            (4, "123", "en", "s", 3), (None, "an unnumbered text of its own", "en", None, 5), (5, "long " * 40_000, None, "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "odd")
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 5, None]
    docs = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


def test_rows_without_own_id_stand_by_their_texts(spark, sf):
    """Null and repeated ids: a rejected row takes no other one along, and near copies without ids go."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text), key=lambda t: len(t.split()))
    copy = " ".join(f"near{i}" for i in range(60))
    texts = [(None, f"first {item} last"), (None, "12 34"), (None, "a clean text without an id of its own"), (None, "another clean text that has no number"),
             (7, f"again {item} here"), (7, "5 6"), (7, "one clean text of the repeated id seven"), (7, "a second and different text of id seven"),
             (None, copy), (None, copy + " tail"), (9, copy + " end")]
    docs = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in texts], schema).repartition(3)
    for _, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), "ids")
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([texts[k] for k in (2, 3, 6, 7, 10)], key=str)


def test_language_stage_without_labels(spark, sf):
    rows = [(1, "some text", None, "s", 9), (2, None, None, "s", None), (3, "12 !", None, "s", 4), (None, "Ωμέγα", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.language_id(spark, docs, sf).collect()} == {1, None}


def test_entry_works_without_the_folder(tmp_path):
    code = """
import builtins, json, sys
real = builtins.__import__
def gone(name, g=None, l=None, fromlist=(), level=0):
    if name.startswith("taxonspark.llm") or name == "corpus_pipeline" or (name == "taxonspark" and "llm" in (fromlist or ())):
        raise ModuleNotFoundError(name, name="taxonspark.llm" if name.startswith("taxonspark") else name)
    return real(name, g, l, fromlist, level)
builtins.__import__ = gone
sys.path.insert(0, %r)
import __spark_entry__ as E
print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))
""" % pipeline.__file__.rsplit("/", 1)[0]
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    queries, sql = json.loads(said.strip().splitlines()[-1])
    assert "cascade_full" in queries and "pipeline" not in queries and not [q for q in queries if q.startswith("op") and q[2].isdigit()]
    assert set(sql) <= set(queries)


def test_registered_queries_read_whole_tables(spark, sf):
    """Every per-row query returns a row per row of its table."""
    import __spark_entry__ as E
    for name, table in (("op6_language_id", "documents"), ("op10_sentence_spans", "documents"), ("op5_html_text", "pages"), ("op3_warc", "pages"),
                        ("op8_e8_lattice", "embeddings"), ("op9_mixing", "documents")):
        assert E.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").agg(F.count("*")).first()[0], name
