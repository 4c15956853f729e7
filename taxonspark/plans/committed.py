"""Committed append (S8): chunks that appear once, whole, or not at all.

A chunk is staged under ``rows/chunk=<id>/attempt=<attempt>`` and then published by one small manifest ``published/<id>.json``
that names the attempt and holds the counts observed while the rows were written. The manifest is written beside and renamed, which
fails where one is there, so of several attempts at a chunk the first published one counts. Readers take the rows of published
attempts only: what a broken or repeated attempt left behind is never seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import SUCCESS_METHODS


class CommittedSink:
    """A folder of published chunks, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifest(self, chunk: str) -> str:
        if not chunk or set(chunk) & set("/\\:=%") or chunk[0] in "._":
            raise ValueError(f"not a chunk id: {chunk!r}")
        return f"{self.path}/published/{chunk}.json"

    def published(self, chunk: str | int) -> dict | None:
        """The manifest of a chunk, None if there is none."""
        fs, p = self._fs(self._manifest(str(chunk)))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def append(self, df: DataFrame, chunk: str | int, counts: dict[str, Column] | None = None, order: str | None = None) -> dict:
        """Append ``df`` as ``chunk`` (rows sorted by ``order`` within files) unless it is published; returns the manifest that counts.
        ``counts`` are aggregates observed on the rows as they are written."""
        chunk = str(chunk)
        done = self.published(chunk)
        if done is not None:
            return done
        attempt, seen = uuid.uuid4().hex, Observation()
        rows = df.sortWithinPartitions(order) if order else df
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in (counts or {}).items()])
        rows.write.parquet(f"{self.path}/rows/chunk={chunk}/attempt={attempt}")
        return self._publish({"chunk": chunk, "attempt": attempt, **seen.get})

    def _publish(self, manifest: dict) -> dict:
        target = self._manifest(manifest["chunk"])
        fs, beside = self._fs(f"{self.path}/publishing/{manifest['attempt']}")
        _, final = self._fs(target)
        fs.mkdirs(final.getParent())
        out = fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if not fs.exists(final):
            fs.rename(beside, final)
        return self.published(manifest["chunk"])

    def manifests(self, schema: str = "chunk string, attempt string, n_rows long") -> DataFrame:
        """One row per published chunk: the fields of ``schema`` in its manifest."""
        fs, p = self._fs(f"{self.path}/published")
        fs.mkdirs(p)
        return self.spark.read.schema(schema).json(f"{self.path}/published")

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows of all published chunks, with ``chunk``; ``schema`` is that of the rows."""
        fs, p = self._fs(f"{self.path}/rows")
        fs.mkdirs(p)
        read = self.spark.read.schema(_with_parts(schema)).parquet(f"{self.path}/rows")
        shown = self.manifests().select(F.col("chunk").alias("_c"), F.col("attempt").alias("_a"))
        return read.join(shown, (F.col("chunk") == F.col("_c")) & (F.col("attempt") == F.col("_a")), "left_semi").drop("attempt")


def _with_parts(schema: T.StructType) -> T.StructType:
    fields = schema.fields
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields if f.name not in ("chunk", "attempt")]
                        + [T.StructField("chunk", T.StringType()), T.StructField("attempt", T.StringType())])


def success_counts() -> dict[str, Column]:
    """A2 as aggregates to observe while results are written."""
    ok = F.col("method").isin(*SUCCESS_METHODS)
    return {"n_success": F.count_if(ok), "n_failed": F.count_if(~ok)}


COUNTS = "chunk string, attempt string, n_rows long, n_success long, n_failed long"
