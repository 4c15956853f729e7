"""Helpers shared by the operators: staging in the shared folder, word arrays, link components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taxonspark.session import checkpoint_dir, ship_package, use_checkpoint_dir


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a fresh local one only on a local master (tests)."""
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        d = use_checkpoint_dir(spark, tempfile.mkdtemp(prefix="taxonspark-llm-"))
    return d.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at the end, also after an error. Gives ``keep(df, tag)``, which stages a table that stays: what is used
    afterwards must stand on kept tables alone."""
    made: list[str] = []
    _scratch.append(made)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = staged(df, tag)
        made.pop()  # the last one made
        return out

    try:
        yield keep
    finally:
        _scratch.pop()
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, is
    computed exactly once and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    if _scratch:
        _scratch[-1].append(path)
    # the job's commit is what counts: no marker file, which the driver would create and set permissions on each time
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package importable in the Python workers, and with Arrow batches of
    fewer rows than Spark's default (a setting of the user's own stays): texts can be long."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "500")
    return spark


def small_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` (already staged) with a broadcast hint if it has at most ``max_rows`` rows; else as it
    is, so that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fewer(df: DataFrame) -> DataFrame:
    """``df``, which holds far less than the documents (ids, links, pairs), in a sixteenth of the shuffle partitions:
    fewer tasks and files, and larger pieces for ``components`` to contract."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of _BASE and of its inverse mod 2^64
CHUNK = 1 << 20  # bytes of text that are hashed at once, if a text or word isn't longer


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def word_hashes(text: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text`` (uint8), A-Z lower-cased and split at ASCII white space and
    at the offsets ``breaks``, with the words' starts and ends. A word's hash is a polynomial of its
    bytes, taken from prefix sums (over a few MB at a time), then mixed with its length."""
    word = ~_SPACE[text]
    n = len(text)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = breaks[(breaks > 0) & (breaks < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + 4 * CHUNK, "right")))
        a, s, e = start[lo], start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        up, down = _powers(int(e[-1]))
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_LOWER[text[a:a + int(e[-1])]] * up[:int(e[-1])], out=sums[1:])
        out[lo:hi] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out, start, end


def range_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes (int64) of the word ranges [lo, hi) by prefix sums of a polynomial of ``words``."""
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix64((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def _hash_runs(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes (int64) of all runs of ``m`` words; the order of the words counts."""
    n = len(words) - m + 1
    acc = np.full(n, m, np.uint64)
    for i in range(m):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[i:n + i]
    return mix64(acc).view(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets with the end) of runs of rows of about ``CHUNK`` bytes of a binary
    column; null counts as empty. The column's own buffer is read, nothing is copied."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes) of the ``k``-word shingles of every text (binary): A-Z
    lower-cased, words split at ASCII white space. Fewer than ``k`` words: the whole sequence as
    one shingle; null or no word: empty."""
    for lo, data, at in text_chunks(texts):
        words, start, _ = word_hashes(data, at[:-1])
        bounds = np.searchsorted(start, at)
        every = _hash_runs(words, k) if len(words) >= k else None
        for i in range(len(at) - 1):
            a, z = int(bounds[i]), int(bounds[i + 1])
            if z - a >= k:
                yield lo + i, _distinct(every[a:z - k + 1])
            else:
                yield lo + i, _hash_runs(words[a:z], z - a) if z > a else np.empty(0, np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over links (a, b): the components within the partition as links to their least node."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
    node, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = where[:len(a)], where[len(a):], np.arange(len(node))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    k = np.flatnonzero(root != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[root[k]])], ["a", "b"])


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long, any order) as (node, component = smallest node).

    Every round contracts the links within each partition, then makes a large-star and a small-star
    step between them: joins with an aggregated side, so a node with very many links is summed map-side and
    its join partition can be split. A round is staged in the shared folder; a partition holds
    links (two longs each), never a component as a whole. Self-links and repeated links are harmless."""
    def stage(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        seen_all = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        got = staged(df.observe(seen, *seen_all), tag)
        return got, (seen.get["n"], seen.get["h"])

    workers(edges)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = stage(fewer(e).mapInArrow(_contract, "a long, b long"))
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # every node also keeps the link to its own minimum
        big = big.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e, now = stage(fewer(small).mapInArrow(_contract, "a long, b long"))
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
