"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "taxonspark", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on; the UI stays off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    use_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or the context's current
    checkpoint folder); None if neither is set."""
    sc = spark.sparkContext
    return (sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
            or sc.getCheckpointDir())


def checkpoint_dir_or_local(spark: SparkSession) -> str:
    """``checkpoint_dir``; when nothing is set, a fresh local folder on a local master (tests) and an
    error on a cluster, whose executors share no local folder."""
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        d = tempfile.mkdtemp(prefix="taxonspark-ckpt-")
    return use_checkpoint_dir(spark, d)


def materialized(df):
    """``df`` computed once and kept in the shared checkpoint folder (a reliable checkpoint): what stands
    behind it runs once and survives lost executors. Spark removes the files with the frame if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    checkpoint_dir_or_local(df.sparkSession)
    return df.checkpoint(eager=True)


def use_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Point reliable checkpoints at ``spark.checkpoint.dir``; ``fallback`` only when unset (tests)."""
    d = checkpoint_dir(spark)
    if d is None:
        d = fallback
    if d is not None:
        spark.sparkContext.setCheckpointDir(d)
    return d


#: how Parquet files are written (unless the session says otherwise): the writer looks at its buffers after 100 rows by default, which
#: are gigabytes if a row has megabytes, and gives up a dictionary of over 1 MB, though the strings in it stand for thousands of rows
WIDE_ROWS = {"parquet.page.size.row.check.min": "8", "parquet.block.size.row.check.min": "8", "parquet.dictionary.page.size": str(32 << 20)}


def expect_wide_rows(spark: SparkSession) -> None:
    """For results whose rows may have strings of megabytes."""
    for k, v in WIDE_ROWS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``taxonspark`` importable in Python workers (``addPyFile`` of a zip, once per context)."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="taxonspark-"), "taxonspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 * 1024 * 1024) -> dict:
    """Session settings sized for the input: enough shuffle partitions that each holds about
    ``target_partition_bytes`` (AQE coalesces small ones and splits skewed ones at run time),
    scan splits of the same size, and skew thresholds relative to it."""
    parts = max(total_cores * 3, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }
