"""The operators as registered queries over the driver tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bond, cuckoo, decontam, htmltext, jaccard, langid, lattice, licenses, linededup, merkle, mixing, spans, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(_table(spark, sf_dir, "documents"), keep=["doc_id", "text"])


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeated_spans(_table(spark, sf_dir, "documents"))


def op8_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.visible_text(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond.mine(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_case_change(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_jaccard, op6_language_id, op7_line_dedup, op10_sentence_spans,
                                   op8_e8_lattice, op3_warc, op5_html_text, op4_license_scan, op9_mixing,
                                   op11_cuckoo_dedup, op12_hard_negatives, op13_merkle_manifest)}
SQL = {"op1_decontaminate": decontam.SQL, "op2_ngram_jaccard": jaccard.SQL, "op7_line_dedup": linededup.SQL,
       "op8_e8_lattice": lattice.SQL, "op3_warc": warc.SQL,
       "op11_cuckoo_dedup": cuckoo.SQL, "op12_hard_negatives": bond.SQL, "op13_merkle_manifest": merkle.SQL}
