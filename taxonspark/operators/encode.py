"""Encode texts to L2-normalised vectors, batched through Arrow.

The reference runs a neural sentence encoder; any encoder ``list[str] -> array (n, d)``
can be plugged in. The built-in default hashes character 1-3-grams into ``dim`` buckets
(deterministic, dependency-free), which is what the tests use. The callable travels with
each task, so a heavy model should be loaded lazily inside it (once per Python worker) and
not captured as a large object.
"""

from __future__ import annotations

import zlib
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def hashed_ngrams(dim: int = 64, n_max: int = 3) -> Callable[[list[str]], np.ndarray]:
    """Default encoder: character n-gram counts hashed (crc32) into ``dim`` buckets."""
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            t = t or ""
            for n in range(1, n_max + 1):
                for j in range(len(t) - n + 1):
                    out[i, zlib.crc32(t[j:j + n].encode("utf-8")) % dim] += 1.0
        return out
    return encode


def l2_rows(mat: np.ndarray) -> np.ndarray:
    """E12 on rows; a zero row is left as is."""
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.where(norms > 0, mat / np.where(norms > 0, norms, 1.0), mat)


def encode_texts(df: DataFrame, text_col: str, encoder: Callable | None = None, out_col: str = "embedding",
                 normalize: bool = True) -> DataFrame:
    """Add ``out_col array<float>``; one encoder per Python worker, one call per Arrow batch
    (batch size = ``spark.sql.execution.arrow.maxRecordsPerBatch``)."""
    ship_package(df.sparkSession)
    enc = encoder or hashed_ngrams()
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()), True)])

    def run(batches):
        for pdf in batches:
            texts = ["" if t is None else str(t) for t in pdf[text_col]]
            mat = np.asarray(enc(texts), dtype=np.float64) if texts else np.zeros((0, 0))
            if normalize and len(texts):
                mat = l2_rows(mat)
            pdf = pdf.copy()
            pdf[out_col] = [row.astype(np.float32) for row in mat] if len(texts) else []
            yield pdf

    return df.mapInPandas(run, schema)


def fill_embeddings(brands: DataFrame, encoder: Callable | None = None) -> DataFrame:
    """Every brand gets a vector of its name (distinct names are encoded once)."""
    names = brands.select("brand_name").distinct()
    vec = encode_texts(names, "brand_name", encoder, "_vec")
    return brands.drop("embedding").join(vec, "brand_name").withColumnRenamed("_vec", "embedding")


def encoded_apart(enc: Callable, texts: list[str]) -> tuple[list, list[str | None]]:
    """A vector for every text, and an error for those that the encoder rejects: a batch that fails is halved until the texts
    that fail stand alone, so the others are encoded."""
    if not texts:
        return [], []
    try:
        mat = l2_rows(np.asarray(enc(texts), dtype=np.float64).reshape(len(texts), -1))
        return [row.astype(np.float32) for row in mat], [None] * len(texts)
    except Exception as exc:  # noqa: BLE001
        if len(texts) == 1:
            return [None], [f"{type(exc).__name__}: {exc}"]
    half = len(texts) // 2
    left, right = encoded_apart(enc, texts[:half]), encoded_apart(enc, texts[half:])
    return left[0] + right[0], left[1] + right[1]


def encode_missing(df: DataFrame, text_col: str, vec_col: str, encoder: Callable | None = None,
                   active=None, error_col: str | None = None) -> DataFrame:
    """Fill ``vec_col`` for rows where it is null (and ``active`` holds) with the encoder's
    L2-normalised vector; other rows pass through unchanged. One encoder call per Arrow batch. With ``error_col``, a text that the encoder
    rejects keeps a null vector and its error there; without, the error ends the job."""
    ship_package(df.sparkSession)
    enc = encoder or hashed_ngrams()
    on = F.col(vec_col).isNull() if active is None else (F.coalesce(active, F.lit(False)) & F.col(vec_col).isNull())
    staged = df.withColumn("_enc_on", on)
    if error_col:
        staged = staged.withColumn(error_col, F.lit(None).cast("string"))
    schema = staged.schema

    def run(batches):
        for pdf in batches:
            mask = pdf["_enc_on"].to_numpy(dtype=bool)
            if mask.any():
                texts = ["" if t is None else str(t) for t in pdf.loc[mask, text_col]]
                pdf = pdf.copy()
                if error_col:
                    vectors, errors = encoded_apart(enc, texts)
                    all_errors = np.full(len(pdf), None, dtype=object)
                    all_errors[mask] = errors
                    pdf[error_col] = all_errors
                else:
                    vectors = [row.astype(np.float32) for row in l2_rows(np.asarray(enc(texts), dtype=np.float64))]
                vals = list(pdf[vec_col])
                for i, row in zip(np.nonzero(mask)[0], vectors):
                    vals[i] = row
                pdf[vec_col] = vals
            yield pdf

    return staged.mapInPandas(run, schema).drop("_enc_on")
