"""Benchmark decontamination: prefix-filtered set join of document shingles with benchmark windows.

Every window (``window`` consecutive words of an item) is a set of word shingles. A document can
only contain the window if it contains all of them, so for exact containment the necessary prefix
is one shingle: the window's rarest by document frequency over the whole corpus. Documents are
joined on those prefix shingles alone; a match at shingle position p must leave room for the
words before it (position bound) and after it (length bound), and the window's words are then
compared one by one.

The benchmark side is broadcast in chunks of a checked size (``max_chunk_bytes`` of item text);
every chunk is joined with all documents, and the hits of several chunks are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, workers

#: bytes of word characters (0-9, a-z, all non-ASCII) kept, A-Z lowered, all others made spaces
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))
_BITS = 21  # a chunk has fewer than 2^21 distinct words, so three word ids fit in one long
GRAM = 3


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of one chunk of items, as word ids (exact, no hashes)."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text or b""))
            if ids:
                n = min(window, len(ids))
                for i in range(len(ids) - n + 1):
                    owners.setdefault(ids[i:i + n], set()).add(item_id)
        if len(self.vocab) >= 1 << _BITS:
            raise ValueError("max_chunk_bytes is too large: over 2 million distinct words in a chunk")
        self.windows = sorted(owners)
        self.items = [tuple(str(x) for x in owners[w] if x is not None) for w in self.windows]
        self.gap = max(map(len, self.windows), default=1)

    def shingles(self) -> dict[int, np.ndarray]:
        """By shingle length: the sorted distinct keys of all windows' shingles."""
        out: dict[int, set] = {}
        for w in self.windows:
            g = min(GRAM, len(w))
            out.setdefault(g, set()).update(pack(w[i:i + g]) for i in range(len(w) - g + 1))
        return {g: np.array(sorted(s), np.int64) for g, s in out.items()}

    def prefixes(self, df: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: prefix keys (sorted, repeated), their window and their offset in it."""
        out: dict[int, list] = {}
        for k, w in enumerate(self.windows):
            g = min(GRAM, len(w))
            at = min(range(len(w) - g + 1), key=lambda i: (df.get((g, pack(w[i:i + g])), 0), pack(w[i:i + g]), i))
            out.setdefault(g, []).append((pack(w[at:at + g]), k, at))
        return {g: tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) for g, rows in out.items()}


def pack(ids: tuple) -> int:
    key = 0
    for i in ids:
        key = key << _BITS | i
    return key


def _word_ids(texts: list, vocab: dict, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' word ids in one array, ``gap`` zeros after each; their starts and lengths."""
    parts, lens, pad = [], [], np.zeros(gap, np.int64)
    get = vocab.get
    for t in texts:
        words = words_of(t) if t else []
        parts += (np.fromiter((get(w, 0) for w in words), np.int64, len(words)), pad)
        lens.append(len(words))
    lens = np.array(lens, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(lens + gap)[:-1])), lens


def _gram_keys(ids: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``g`` known words follow each other, and their keys."""
    n = len(ids) - g + 1
    known = ids[:n] > 0
    for i in range(1, g):
        known &= ids[i:n + i] > 0
    at = np.flatnonzero(known)
    key = np.zeros(len(at), np.int64)
    for i in range(g):
        key = key << _BITS | ids[at + i]
    return at, key


def _found(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def _count_shingles(index, grams):
    """mapInArrow: (length, key, number of documents) of the windows' shingles, one row per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, starts, _ = _word_ids(b.column(0).slice(lo, 256).to_pylist(), ix.vocab, ix.gap)
                for g, table in grams.items():
                    at, key = _gram_keys(ids, g)
                    ok = _found(key, table)
                    doc = np.searchsorted(starts, at[ok], "right")
                    one = np.unique(np.stack((key[ok], doc)), axis=1)[0] if ok.any() else key[ok]
                    k, n = np.unique(one, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g, np.int32)), pa.array(k),
                                                      pa.array(n.astype(np.int64))], ["g", "key", "n"])
    return run


def _hits(ids: np.ndarray, ix: Windows, prefixes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts and window numbers of all exact occurrences."""
    if not ix.windows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lens = np.array([len(w) for w in ix.windows], np.int64)
    flat = np.concatenate([np.array(w, np.int64) for w in ix.windows])
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    starts, wins = [], []
    for g, (pkey, pwin, poff) in prefixes.items():
        at, key = _gram_keys(ids, g)
        lo, hi = np.searchsorted(pkey, key, "left"), np.searchsorted(pkey, key, "right")
        some = np.flatnonzero(hi > lo)
        for part in np.array_split(some, max(1, int((hi - lo)[some].sum()) // 500_000)):
            n = (hi - lo)[part]
            row = np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, s = pwin[row], np.repeat(at[part], n) - poff[row]
            fits = (s >= 0) & (s + lens[w] <= len(ids))  # position and length bound; zeros end a document
            w, s = w[fits], s[fits]
            for i in range(int(lens[w].max(initial=0))):
                here = i < lens[w]
                same = np.ones(len(w), bool)
                same[here] = ids[s[here] + i] == flat[first[w[here]] + i]
                w, s = w[same], s[same]
            starts.append(s)
            wins.append(w)
    none = np.empty(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(wins or [none])


def _match(index, prefix):
    """mapInArrow over (row key columns..., text): n_words, covered word ranges and item ids of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, prefixes = index.value, prefix.value
        win_len = np.array([len(w) for w in ix.windows], np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, starts, lens = _word_ids(part.column(part.num_columns - 1).to_pylist(), ix.vocab, ix.gap)
                s, w = _hits(ids, ix, prefixes)
                doc = np.searchsorted(starts, s, "right") - 1
                spans: list = [[] for _ in range(len(lens))]
                items: list = [[] for _ in range(len(lens))]
                order = np.lexsort((s, doc))
                for d in np.unique(doc):
                    mine = order[np.searchsorted(doc[order], d):np.searchsorted(doc[order], d, "right")]
                    spans[d] = merge((int(s[i] - starts[d]), int(s[i] - starts[d] + win_len[w[i]])) for i in mine)
                    items[d] = sorted({x for i in np.unique(w[mine]) for x in ix.items[i]})
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(lens), pa.array(spans, pa.list_(pa.int64())),
                     pa.array(items, pa.list_(pa.string()))],
                    [*part.schema.names[:-1], "n_words", "spans", "items"])
    return run


def merge(ranges) -> list[int]:
    """Sorted (start, end) ranges united, as a flat list of bounds."""
    out: list[int] = []
    for a, z in ranges:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += (a, z)
    return out


_COVERED = "aggregate(sequence(1, size(spans) div 2), 0L, (n, i) -> n + spans[2*i-1] - spans[2*i-2])"


def _one_chunk(base: DataFrame, items: list[tuple], window: int, keys: str) -> DataFrame:
    spark = workers(base)
    ix = Windows(items, window)
    out = f"{keys}, n_words long, spans array<long>, items array<string>"
    shared = spark.sparkContext.broadcast(ix)
    df: dict[int, int] = {}
    if ix.windows:
        counted = base.select("_t").mapInArrow(_count_shingles(shared, ix.shingles()), "g int, key long, n long")
        # one row per shingle of the chunk at most
        df = {(r.g, r.key): r.n for r in counted.groupBy("g", "key").agg(F.sum("n").alias("n")).collect()}
    return base.mapInArrow(_match(shared, spark.sparkContext.broadcast(ix.prefixes(df))), out)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", max_chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any occurring window),
    items (sorted string ids of items with occurring windows), n_items, contaminated.

    Null or wordless texts have 0 words and no hits; null or wordless items have no window; an item
    without id marks words but is not listed; repeated items count once; repeated documents each get
    their row; no items or no documents give no hits or no rows. Other columns are not read."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t"))
    items = staged(items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"),
                                F.coalesce(F.octet_length(item_text), F.lit(0)).cast("long").alias("b")), "items")
    total = items.agg(F.sum("b")).first()[0] or 0
    n = int(total // max_chunk_bytes) + 1
    if n == 1:
        rows = _one_chunk(docs, [(r.i, r.t) for r in items.select("i", "t").collect()], window, "doc_id long")
    else:
        base = docs.withColumn("_h", F.xxhash64("_t")).select("doc_id", "_h", "_t")
        chunk = items.withColumn("c", F.pmod(F.xxhash64("i", "t"), F.lit(2 * n)))
        found = None
        for c in range(2 * n):
            part = [(r.i, r.t) for r in chunk.where(F.col("c") == c).select("i", "t").collect()]
            if part:
                hit = staged(_one_chunk(base, part, window, "doc_id long, _h long").where("size(spans) > 0"), "hits")
                found = hit if found is None else found.unionByName(hit)
        merged = found.groupBy("doc_id", "_h").agg(
            F.flatten(F.collect_set("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        merged = merged.selectExpr("doc_id k", "_h kh", "items", """aggregate(
            array_sort(transform(sequence(1, size(s) div 2), i -> named_struct('a', s[2*i-2], 'z', s[2*i-1]))),
            cast(array() as array<bigint>), (o, r) -> if(size(o) > 0 and r.a <= element_at(o, -1),
            concat(slice(o, 1, size(o) - 1), array(greatest(element_at(o, -1), r.z))), concat(o, array(r.a, r.z)))) spans""")
        empty = _one_chunk(base, [], window, "doc_id long, _h long").select("doc_id", "_h", "n_words")
        rows = empty.join(merged, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("_h") == F.col("kh")), "left").select(
            "doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<bigint>)")).alias("spans"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    rows = rows.withColumn("n_hit", F.expr(f"if(size(spans) = 0, 0L, {_COVERED})"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                       (F.col("n_hit") > 0).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    """The query's columns: the item ids as one SHA-256."""
    return result.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: The same by listing every window of every item and every document position.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, p, p + least(10, len(w)) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, p, pos.n FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
