"""Hard negatives by a vertical scan of the vectors' dimensions (BOND).

Rows are dealt into blocks that hold their vectors by dimension, with every dimension's least and largest value. An
anchor reads a block's dimensions in the order of its own magnitudes, largest first. After every few
dimensions the least and the largest value of each one still unread bound what can come; candidates whose bounds
can't reach the best scores (positives), or can't end inside a score window and among its best (negatives), leave
the block's bitmap. What survives the last dimension has its exact score. Anchors and blocks meet in cells of
bounded size; a cell gives the few best of each anchor, and a ranking keeps the best over all cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_broadcast, staged, workers

#: dimensions read between two prunings
STEP = 16
EXACT = float(1 << 53)


def scan(anchor: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, bitmap: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``columns`` (dimensions x rows) that survive, of those in ``bitmap``, and their exact scores. ``keep`` takes the rows
    left, the lower and the upper bounds of their scores and the dimensions left to read, and tells which stay."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    a, b = anchor * least, anchor * most
    low, high = np.minimum(a, b)[order], np.maximum(a, b)[order]
    live = np.flatnonzero(bitmap)
    score = np.zeros(len(live), columns.dtype)
    for at in range(0, len(order), STEP):
        dims = order[at:at + STEP]
        score = score + anchor[dims] @ (columns[dims] if len(live) == columns.shape[1] else columns[dims[:, None], live])
        left = max(0, len(order) - at - STEP)
        stay = keep(live, score + low[at + STEP:].sum(), score + high[at + STEP:].sum(), left)
        if not stay.all():
            live, score = live[stay], score[stay]
        if not len(live):
            break
    return live, score


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) > k else None


def best_of(k: int):
    """Keep what can be among the ``k`` highest scores (ties stay)."""
    def keep(live, low, high, left):
        limit = _kth(low, k)
        return np.ones(len(low), bool) if limit is None else high >= limit
    return keep


def inside(windows: list[tuple[int, int]], k: int):
    """Keep what can be among the ``k`` highest scores inside one of ``windows`` (both ends belong to them)."""
    bottom, top = min(w[0] for w in windows), max(w[1] for w in windows)

    def keep(live, low, high, left):
        stay = (high >= bottom) & (low <= top)
        if left and stay.sum() > 4 * k:  # a window's k-th lower bound, among those sure to be in it, is a limit too
            some = np.flatnonzero(stay)
            l, h, any_ = low[some], high[some], np.zeros(len(some), bool)
            for a, b in windows:
                limit = _kth(l[(l >= a) & (h <= b)], k)
                any_ |= (l <= b) & (h >= (a if limit is None else max(a, limit)))
            stay[some] = any_
        return stay
    return keep


def _highest(ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` first of ``rows`` by score, then id."""
    return np.lexsort((ids[rows], -score))[:k]


def window_of(score: int, lower: int, upper: int) -> tuple[int, int]:
    """Least and largest negative score for a positive's: lower and upper hundredths of it, in whole numbers."""
    return -(-lower * score // 100), upper * score // 100


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _cells(found):
    """mapInArrow over rows sorted by (cell, anchor first): calls ``found(anchors, candidates)`` for each whole cell."""
    names = ("lab", "row", "vec_id", "scores", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            cell = pa.Table.from_batches(held)
            side = cell["side"].to_numpy()
            n = int((side == 0).sum())
            if 0 < n < len(side):
                part = cell.select(names).combine_chunks()
                yield from found(part.slice(0, n).to_batches()[0], part.slice(n).to_batches()[0])

        key = None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(c).to_numpy() for c in ("part", "i", "j")]
            edges = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(x[lo] for x in at)
                if held and key != now:
                    yield from done()
                    held = []
                held.append(b.slice(lo, hi - lo))
                key = now
        if held:
            yield from done()
    return run


def _by_length(anchors: pa.RecordBatch, rows: pa.RecordBatch):
    """Anchors and candidates of one vector length as arrays, one length after the other. Whole numbers are exact in doubles while no
    score can pass 2 ** 53; beyond that Python integers are used."""
    la, lr = anchors["v"].value_lengths().to_numpy(), rows["v"].value_lengths().to_numpy()
    for d in np.intersect1d(la, lr).tolist():
        a, r = anchors.take(pa.array(np.flatnonzero(la == d))), rows.take(pa.array(np.flatnonzero(lr == d)))
        q, c = _matrix(a["v"], d), _matrix(r["v"], d)
        if d and np.abs(q).max() * np.abs(c).max() * d >= EXACT:
            q, c = (np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (q, c))
        yield a, r, q, np.ascontiguousarray(c.T)


def _positives(k: int):
    """(row, score, vec_id) of the ``k`` highest rows of the cell for each anchor, itself left out."""
    def found(anchors, rows):
        for a, r, q, columns in _by_length(anchors, rows):
            ids, own = r["vec_id"].to_numpy(), r["row"].to_numpy()
            low, high = columns.min(axis=1), columns.max(axis=1)
            out = [], [], []
            for row, anchor in zip(a["row"].to_numpy(), q, strict=True):
                live, score = scan(anchor, columns, low, high, own != row, best_of(k))
                best = _highest(ids, live, score, k)
                out[0].extend([row] * len(best))
                out[1].extend(int(x) for x in score[best])
                out[2].extend(ids[live[best]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "score", "vec_id"])
    return _cells(found)


def _negatives(k: int, lower: int, upper: int):
    """(row, positive score, score, vec_id) of the ``k`` highest rows in the window of each positive score, of other labels."""
    def found(anchors, rows):
        for a, r, q, columns in _by_length(anchors, rows):
            ids, labels = r["vec_id"].to_numpy(), r["lab"].to_numpy()
            low, high = columns.min(axis=1), columns.max(axis=1)
            out = [], [], [], []
            for row, label, scores, anchor in zip(a["row"].to_numpy(), a["lab"].to_numpy(), a["scores"].to_pylist(), q, strict=True):
                windows = {s: window_of(s, lower, upper) for s in scores}
                windows = {s: w for s, w in windows.items() if w[0] <= w[1]}
                if not windows:
                    continue
                live, score = scan(anchor, columns, low, high, labels != label, inside(list(windows.values()), k))
                for s, (bottom, top) in windows.items():
                    at = np.flatnonzero((score >= bottom) & (score <= top))
                    best = at[_highest(ids, live[at], score[at], k)]
                    out[0].extend([row] * len(best))
                    out[1].extend([s] * len(best))
                    out[2].extend(int(x) for x in score[best])
                    out[3].extend(ids[live[best]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row", "positive_score", "score", "vec_id"])
    return _cells(found)


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of anchors (part, i, blocks) and rows (part, j, chunks): each anchor goes to all blocks of its part, each row to all
    chunks of anchors."""
    cols = ["lab", "row", "vec_id", "scores", "v"]
    a = anchors.select("part", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *cols)
    r = rows.select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "j", F.lit(1).alias("side"), *cols)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.unionByName(r).repartition(parts, "part", "i", "j").sortWithinPartitions("part", "i", "j", "side")


def _dealt(name: str, n: Column) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(name)), n).cast("int").alias(name)


def hard_negatives(vectors: DataFrame, *, anchors: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: int = 256,
                   block: int = 2048, chunk: int = 1024) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of other labels with a score of ``lower`` to ``upper`` hundredths of the positive's.

    Vectors become floor(scale * x); scores are inner products with the anchor, exact in whole numbers (and must fit a long);
    higher ones come first, ties by smaller id. ``anchors`` is a condition on the input's columns (all rows by default). Rows with a
    null id, label or vector or a null or non-finite component take no part; only vectors of one length are compared; identical
    rows count once, different rows of one id are rows of their own. An anchor without positives or without rows in the window has
    no rows; an empty table gives none; other columns are not read."""
    workers(vectors)
    name = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(F.lit(True) if anchors is None else anchors, F.lit(False)).alias("anchor"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~bad)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))).distinct()
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).where("a > 0")
    sizes = sizes.select("label", F.xxhash64("label").alias("lab"), F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("a") / chunk).alias("chunks"))
    sizes = small_broadcast(staged(sizes, "labels"), 100_000)
    # positives: the cells of a label
    own = rows.join(sizes, "label").select(F.col("lab").alias("part"), F.xxhash64("label").alias("lab"), "row", "vec_id", F.lit(None).cast("array<long>").alias("scores"),
                                           "v", "anchor", "blocks", "chunks", _dealt("i", F.col("chunks")), _dealt("j", F.col("blocks")))
    near = _met(own.where("anchor"), own).mapInArrow(_positives(positives), "row long, score long, vec_id long")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    near = staged(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives).drop("k"), "positives")
    # negatives: the cells of all labels, with the windows of an anchor's distinct positive scores
    scores = near.groupBy(F.col("row").alias("_r")).agg(F.collect_set("score").alias("scores"))
    asked = rows.where("anchor").join(scores, F.col("row") == F.col("_r")).select("label", "row", "vec_id", "scores", "v")
    asked = staged(asked, "asked")
    n, a = rows.count(), asked.count()
    grid = {"part": F.lit(0).cast("long"), "blocks": F.lit(max(1, -(-n // block))), "chunks": F.lit(max(1, -(-a // chunk)))}
    asked = asked.select(grid["part"].alias("part"), _dealt("i", grid["chunks"]), grid["blocks"].alias("blocks"), F.xxhash64("label").alias("lab"), "row", "vec_id", "scores", "v")
    every = rows.select(grid["part"].alias("part"), _dealt("j", grid["blocks"]), grid["chunks"].alias("chunks"), F.xxhash64("label").alias("lab"), "row", "vec_id",
                        F.lit(None).cast("array<long>").alias("scores"), "v")
    far = _met(asked, every).mapInArrow(_negatives(negatives, lower, upper), "row long, positive_score long, score long, vec_id long")
    first = Window.partitionBy("row", "positive_score").orderBy(F.desc("score"), "vec_id")
    far = staged(far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives), "negatives")
    far = far.select(F.col("row").alias("_r"), F.col("positive_score").alias("_s"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.join(rows.where("anchor").select(F.col("row").alias("_a"), F.col("vec_id").alias("anchor_id")), F.col("row") == F.col("_a"))
    out = pairs.join(far, (F.col("row") == F.col("_r")) & (F.col("score") == F.col("_s")))
    return out.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
                      F.col("score").alias("positive_score"), "negative_score")


def mine(vectors: DataFrame) -> DataFrame:
    """``hard_negatives`` of every row whose id is divisible by 50, with labels shifted where the id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, anchors=F.col("vec_id") % 50 == 0, label=label)


SQL = """
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
     FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
     FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
      FROM p JOIN s ON p.a = s.a AND s.la <> s.lb AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""
