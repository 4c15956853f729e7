"""Exact deduplication by a cuckoo-filter index of live digests.

The index keeps one filter per shard of the digest space: buckets of four 16-bit fingerprints, with the
stored digest beside every fingerprint. A digest whose fingerprint is in neither of its buckets is new and inserted;
a fingerprint hit is compared with the stored digests of the two buckets, so a false positive is inserted as
well and can be deleted later without touching the other. An insertion that finds no place within ``KICKS``
moves doubles the filter and refills it from the stored digests. Digests that were hit twice or more are then verified against the
contents: only those texts are gathered, by digest and text. Before the shuffle to the shards every task
reduces its digests to distinct ones, so a text that a third of all rows hold is a row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_broadcast, staged, workers

SLOTS, KICKS, WIDTH = 4, 200, 32
#: rows whose digests a task reduces at once before they are shuffled
COMBINE = 65_536


class CuckooFilter:
    """Fingerprints of stored digests (bytes of ``WIDTH``), found in one of two buckets each."""

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.prints = np.zeros(buckets * SLOTS, np.uint16)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.n = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[8:16], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 3 & self.mask)

    def slot(self, digest: bytes) -> int:
        """Where ``digest`` is stored, -1 if nowhere; a fingerprint alone doesn't count."""
        mark, *places = self._places(digest)
        for b in places:
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[s] == mark and self.keys[s] == digest:
                    return s
        return -1

    def insert(self, digest: bytes) -> bool:
        """Store ``digest``; False if it is stored already."""
        if self.slot(digest) >= 0:
            return False
        while not self._place(digest):
            self._grow()
        self.n += 1
        return True

    def _place(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        moved: list[int] = []
        bucket = first
        for turn in range(KICKS):
            for b in (first, second) if turn == 0 else (bucket,):
                for s in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.keys[s] = mark, digest
                        return True
            s = bucket * SLOTS + turn % SLOTS  # the evicted one goes to its other bucket
            moved.append(s)
            old_mark, old = int(self.prints[s]), self.keys[s]
            self.prints[s], self.keys[s] = mark, digest
            mark, digest = old_mark, old
            bucket = self._other(bucket, mark)
        for s in reversed(moved):  # nothing is lost: the moves are undone, then the caller resizes
            old_mark, old = int(self.prints[s]), self.keys[s]
            self.prints[s], self.keys[s] = mark, digest
            mark, digest = old_mark, old
        return False

    def _grow(self) -> None:
        """Twice the buckets (more, if even those overflow), refilled from the stored digests."""
        stored, buckets = [k for k in self.keys if k is not None], self.mask + 1
        while True:
            buckets *= 2
            self.mask, self.prints, self.keys = buckets - 1, np.zeros(buckets * SLOTS, np.uint16), [None] * (buckets * SLOTS)
            if all(self._place(k) for k in stored):
                return

    def delete(self, digest: bytes) -> bool:
        s = self.slot(digest)
        if s < 0:
            return False
        self.prints[s], self.keys[s] = 0, None
        self.n -= 1
        return True

    def dump(self) -> tuple[bytes, bytes]:
        return self.prints.tobytes(), b"".join(k for k in self.keys if k is not None)

    @classmethod
    def load(cls, prints: bytes, keys: bytes) -> CuckooFilter:
        out = cls(len(prints) // 2 // SLOTS)
        out.prints[:] = np.frombuffer(prints, np.uint16)
        for i, s in enumerate(np.flatnonzero(out.prints).tolist()):
            out.keys[s] = keys[i * WIDTH:(i + 1) * WIDTH]
        out.n = len(keys) // WIDTH
        return out


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow (digest) -> (digest, many): the distinct digests of every ``COMBINE`` rows, and whether a digest came more than once."""
    def counted(held: list) -> pa.RecordBatch:
        got = pc.value_counts(pa.chunked_array(held))
        return pa.RecordBatch.from_arrays([got.field("values"), pc.greater(got.field("counts"), 1)], ["digest", "many"])

    held, rows = [], 0
    for b in batches:
        held.append(b.column(0))
        rows += b.num_rows
        if rows >= COMBINE:
            yield counted(held)
            held, rows = [], 0
    if rows:
        yield counted(held)


OPS = "shard int, kind int, digest binary, many boolean, prints binary, keys binary"
STATE, DELETE, INSERT = 0, 1, 2


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (shard, kind): a shard's stored state, then deletions, then insertions -> its new state, and as
    ``INSERT`` rows the digests that were stored before or came again, as ``DELETE`` rows those deleted."""
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("many", pa.bool_()),
                        ("prints", pa.binary()), ("keys", pa.binary())])

    def rows(shard: int, kind: int, digests: list, prints: list | None = None, keys: list | None = None) -> pa.RecordBatch:
        n = len(digests)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
            ([shard] * n, [kind] * n, digests, [None] * n, prints or [None] * n, keys or [None] * n), schema, strict=True)], schema=schema)

    shard, index, out = None, CuckooFilter(), {DELETE: [], INSERT: []}

    def done() -> Iterator[pa.RecordBatch]:
        prints, keys = index.dump()
        yield rows(shard, STATE, [None], [prints], [keys])
        for kind, digests in out.items():
            if digests:
                yield rows(shard, kind, digests)

    for b in batches:
        for s, kind, digest, many, prints, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                if shard is not None:
                    yield from done()
                shard, index, out = s, CuckooFilter(), {DELETE: [], INSERT: []}
            if kind == STATE:
                index = CuckooFilter.load(prints, keys)
            elif kind == DELETE:
                if index.delete(digest):
                    out[DELETE].append(digest)
            elif not index.insert(digest) or many:
                out[INSERT].append(digest)
    if shard is not None:
        yield from done()


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Live rows and their digests: ``insert`` and ``delete`` batches of rows, ``groups`` gives the classes of equal texts.

    Everything is kept as Parquet in the shared folder: the batches with their digests and texts, the ids deleted, and a generation
    of shard filters per update (a lost executor's tasks repeat from the generation before). ``shard_rows`` digests
    make a shard of the first batch; later ones let the filters grow, by doubling."""

    def __init__(self, spark, *, digest=sha256_digest, shard_rows: int = 1 << 16, least_shards: int = 64):
        self.spark, self.digest, self.shard_rows, self.least = spark, digest, shard_rows, least_shards
        self.shards = self.batches = 0
        self.live: DataFrame | None = None
        self.state: DataFrame | None = None
        self.hits: DataFrame | None = None

    def insert(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add the rows of ``docs`` (null texts count as empty) and return the digests that were hit (``digest``)."""
        workers(docs)
        self.batches += 1
        content = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.col(doc_id).alias("doc_id"), self.digest(content).alias("digest"), content.alias("text"))
        rows = staged(rows.withColumn("row", F.concat_ws("-", F.lit(self.batches), F.monotonically_increasing_id())), "live")
        if not self.shards:
            self.shards = max(self.least, -(-rows.count() // self.shard_rows))
        combined = rows.select("digest").mapInArrow(_combined, "digest binary, many boolean")
        found = self._apply(combined, INSERT)
        hits = found.where(F.col("kind") == INSERT).select("digest").distinct()
        self.hits = hits if self.hits is None else staged(self.hits.unionByName(hits).distinct(), "hits")
        self.live = rows if self.live is None else self.live.unionByName(rows)
        return hits

    def delete(self, ids: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
        """Remove the rows of these ids (null matches none); return the digests that no row holds any more (``digest``)."""
        gone = staged(ids.select(F.col(doc_id).alias("_gone")).distinct(), "gone")
        out = staged(self.live.join(gone, F.col("doc_id") == F.col("_gone"), "left_semi").select("digest").distinct(), "left")
        self.live = staged(self.live.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"), "live")
        dead = out.join(self.live.select("digest"), "digest", "left_anti")
        found = self._apply(dead.withColumn("many", F.lit(False)), DELETE)
        return found.where(F.col("kind") == DELETE).select("digest")

    def _apply(self, digests: DataFrame, kind: int) -> DataFrame:
        none = F.lit(None).cast("binary")
        ops = digests.select(F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard"), F.lit(kind).alias("kind"), "digest", "many",
                             none.alias("prints"), none.alias("keys"))
        if self.state is not None:
            ops = ops.unionByName(self.state)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found = staged(ops.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_update, OPS), "filters")
        self.state = found.where(F.col("kind") == STATE)
        return found

    def groups(self) -> DataFrame:
        """One row per live row: doc_id, keep_id (largest doc_id of an equal text), group_size, kept, digest."""
        often = staged(self.hits, "hit")
        again = self.live.join(small_broadcast(often, 500_000), "digest", "left_semi")
        best = F.max(F.struct("doc_id", "row")).alias("best")
        content = staged(again.groupBy("digest", "text").agg(F.count("*").alias("n"), best).select("digest", "best", "n"), "contents")
        clash = staged(content.groupBy("digest").count().where("count > 1").select("digest"), "clashes")
        rows, told = self.live.select("doc_id", "row", "digest"), None
        if clash.limit(1).count():  # different texts of one digest: these rows are told apart by the text itself
            clash = small_broadcast(clash, 500_000)
            content = content.join(clash, "digest", "left_anti")
            told = self.live.join(clash, "digest", "left_semi")
            by_text = told.groupBy("text").agg(F.count("*").alias("n"), best)
            told = told.join(by_text, "text").select("doc_id", "row", "digest", "best", "n")
            rows = rows.join(clash, "digest", "left_anti")
        found = rows.join(small_broadcast(content.withColumnRenamed("digest", "_d"), 500_000), F.col("digest") == F.col("_d"), "left")
        found = found.select("doc_id", "row", "digest", "best", "n")
        if told is not None:
            found = found.unionByName(told)
        return found.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                            F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical as they are; null counts as empty. Of equal texts the row of the largest doc_id
    stays (a null id counts as the smallest; of several rows of that id exactly one stays). Texts of any length are
    hashed and compared whole, an empty table gives no rows, other columns are not read."""
    index = DigestIndex(docs.sparkSession, **options)
    index.insert(docs, doc_id=doc_id, text=text)
    out = index.groups()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
