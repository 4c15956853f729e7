"""Nearest verified brand per text.

score(text, brand) = w * cos01(text_vec . brand_vec) + (1 - w) * jaro_winkler(text, brand_name)
(brand without a vector -> cos01 = 0.0; ``use_combined=False`` -> cos01 only).
The best brand is the argmax with ties to the lowest ``brand_idx``; brands with a blank
name are skipped; NaN scores never win; a best score below the threshold means no match.

Plans (same result, chosen by a checked size):

* broadcast: brand ids, names and vectors (size-checked) are broadcast once; each Arrow
  batch of texts is scored with one numpy matmul, and Jaro-Winkler is evaluated only for brands
  whose bound, first of a group of similar names and then of the name itself, can still reach
  the running best (exact pruning, ``functions/names``).
* grid: brands are dealt into blocks of similar vectors (``operators/balls``). A first round scores every text against the
  block of its highest bound, a second one against only those blocks whose bound reaches that score. A cell of a block and a
  bucket of texts is one ``cogroup`` task of bounded size that emits a partial top-1 per text, and a partial/final
  ``max(struct(score, -brand_idx))`` aggregation merges the blocks. No pair is ever materialised. Texts without a vector have blocks
  of brands whose names are alike.
  Where the blocks' summaries are too large to broadcast, or brand vectors differ in length, every text meets every block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import Cosines, Dots, NameIndex, best_of
from ..functions.similarity import HIST_BUCKETS
from ..functions.text import strip
from ..session import materialized, ship_package
from ..params import DEFAULT_PARAMS, Params
from .balls import Balls

BRAND_SCHEMA = T.StructType([
    T.StructField("brand_idx", T.LongType(), False),
    T.StructField("brand_code", T.StringType(), False),
    T.StructField("brand_name", T.StringType(), False),
    T.StructField("brand_keywords", T.StringType(), False),
    T.StructField("atomic", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

def _fmt4(x: float) -> str:
    return f"{x:.4f}"


def _to_matrix(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Stack possibly-null vectors into a float64 matrix plus a has-vector mask."""
    n = len(vectors)
    mat = np.zeros((n, dim), dtype=np.float64)
    has = np.zeros(n, dtype=bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            mat[i] = np.asarray(v, dtype=np.float64)
            has[i] = True
    return mat, has


def score_block(texts: list[str], qmat: np.ndarray, qhas: np.ndarray, block: dict,
                w: float, use_combined: bool, active=None, floor=None):
    """Best brand per text within one brand block: (positions, scores); position -1 = none, or maybe none that reaches the ``floor``.

    Ties go to the brand of the lowest ``rank`` (order of ``brand_idx``). Combined scores: ``functions/names`` bounds Jaro-Winkler for
    groups of names, then for the names of the groups that can still win, and computes it for what is left. Exact: a brand
    that is skipped cannot reach the maximum.
    """
    m, n = len(block["ids"]), len(texts)
    pos, score = [-1] * n, [float("nan")] * n
    on = [i for i in range(n) if active is None or active[i]]
    if m == 0 or not on:
        return pos, score
    index, vectors = block["index"], qhas.any() and block["has"].any()
    if use_combined:
        # the product with every name in double precision: for texts that are compared with all of them, or vectors that float32 can't bound
        whole = np.array([index.is_long(texts[i]) for i in on]) | (vectors and not Dots.fits(qmat[on], block["norm"]))
        for rows, all_names in ((np.array(on)[~whole], False), (np.array(on)[whole], True)):
            if not len(rows):
                continue
            cos = None
            if vectors:
                cos = (Cosines(_cos01(qmat[rows], qhas[rows], block)) if all_names
                       else Dots(qmat[rows], qhas[rows], block["mat"], block["has"], block["norm"]))
            found = index.best([texts[i] for i in rows], cos, w, qhas[rows], None if floor is None else floor[rows])
            for i, (p, s) in zip(rows.tolist(), found, strict=True):
                pos[i], score[i] = p, s
        return pos, score
    cos = _cos01(qmat[on], qhas[on], block) if vectors else np.zeros((len(on), m))
    for k, i in enumerate(on):
        pos[i], score[i] = best_of(np.clip(cos[k], 0.0, 1.0), index.rank)
    return pos, score


def _cos01(qmat: np.ndarray, qhas: np.ndarray, block: dict) -> np.ndarray:
    if "wide" not in block:
        block["wide"] = block["mat"].astype(np.float64)
    cos = qmat @ block["wide"].T
    cos += 1.0  # in place: these are the largest arrays of the kernel
    cos /= 2.0
    if not block["has"].all():
        cos[:, ~block["has"]] = 0.0
    if not qhas.all():
        cos[~qhas, :] = 0.0
    return cos


_OUT_FIELDS = [
    T.StructField("brand_idx", T.LongType(), True),
    T.StructField("brand_name", T.StringType(), True),
    T.StructField("brand_code", T.StringType(), True),
    T.StructField("brand_atomic", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
    T.StructField("score_text", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
]
_OUT = tuple(f.name for f in _OUT_FIELDS)
#: texts without vectors that are compared with a block's names together
TEXTS_AT_ONCE = 512


def _score_frame(pdf: pd.DataFrame, carry: list[str], block: dict, dim: int, w: float,
                 use_combined: bool, cells: int) -> pd.DataFrame:
    """Score one pandas batch of texts against one brand block; one output row per text
    (brand columns null when none qualifies or the row is inactive). Each matmul is bounded
    by ``cells`` text x brand scores."""
    ids = block["ids"]
    rows_per = max(1, cells // max(1, len(ids))) if pdf["_kv"].notna().any() else TEXTS_AT_ONCE
    cols = {k: [] for k in _OUT}
    for start in range(0, len(pdf), rows_per):
        part = pdf.iloc[start:start + rows_per]
        texts = ["" if t is None else t for t in part["_kt"]]
        vecs = list(part["_kv"])
        floor = part["_seed"].to_numpy(dtype=float) if "_seed" in part else None
        active = part["_ka"].to_numpy(dtype=bool)
        # C4: a vector whose length differs from the brands' cannot be scored (the dot product
        # raises in the reference); that row becomes an error row and the others go on
        err = [block.get("dim_error") if on else None for on in active]
        for i, v in enumerate(vecs):
            if err[i] is None and active[i] and v is not None and dim and len(v) != dim:
                err[i] = f"ValueError: text vector has {len(v)} values, brand vectors have {dim}"
        try:
            qmat, qhas = _to_matrix(vecs, dim)
            ok_rows = active & np.array([e is None for e in err], dtype=bool)
            pos, sc = score_block(texts, qmat, qhas, block, w, use_combined, ok_rows, floor)
        except Exception:  # any other failure: score the rows one by one, so only the bad ones become error rows
            pos, sc = [-1] * len(texts), [float("nan")] * len(texts)
            for i in np.flatnonzero(active & np.array([e is None for e in err], dtype=bool)):
                try:
                    (pos[i],), (sc[i],) = score_block([texts[i]], *_to_matrix([vecs[i]], dim), block, w, use_combined)
                except Exception as exc:  # noqa: BLE001
                    err[i] = f"{type(exc).__name__}: {exc}"
        for p, s_, e in zip(pos, sc, err):
            brand = None
            if p >= 0:
                try:
                    brand = int(ids[p]), block["names"][p], block["codes"][p], block["atomics"][p]
                except Exception as exc:  # noqa: BLE001
                    e = f"{type(exc).__name__}: {exc}"
            for k, v in zip(_OUT, (*(brand or (None,) * 4), float(s_) if brand else None, _fmt4(s_) if brand else None, e), strict=True):
                cols[k].append(v)
    out = pdf[carry].reset_index(drop=True).copy()
    for k in _OUT:
        out[k] = pd.Series(cols[k], dtype=object)
    return out


def _block_from_pandas(bpdf: pd.DataFrame, dim: int) -> dict:
    bpdf = bpdf.sort_values("brand_idx", kind="stable")
    index = NameIndex([str(x) for x in bpdf["brand_name"]])
    bpdf = bpdf.iloc[index.rank]  # in the index's order; its rank is the place by brand_idx
    vecs = list(bpdf["embedding"])
    mat, has = _to_matrix(vecs, dim)
    narrow = mat.astype(np.float32)  # as the vectors of a brand table are
    mat = narrow if np.array_equal(narrow, mat, equal_nan=True) else mat
    bad = sorted({len(v) for v in vecs if v is not None and len(v) != dim})
    dim_error = f"ValueError: brand vectors have {bad[0]} and {dim} values" if bad else None
    return {"ids": bpdf["brand_idx"].to_numpy(dtype=np.int64), "names": [str(x) for x in bpdf["brand_name"]],
            "codes": [str(x) for x in bpdf["brand_code"]], "atomics": [str(x) for x in bpdf["atomic"]],
            "mat": mat, "has": has, "norm": float(np.sqrt((mat.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)),
            "index": index, "name_mat": index.mat, "dim_error": dim_error}


def _live_brands(brands: DataFrame) -> DataFrame:
    return (brands.where(strip("brand_name") != "")
            .select("brand_idx", "brand_name", "brand_code", "atomic", "embedding"))


def top1(texts: DataFrame, brands: DataFrame, keys, text_col: str, vec_col: str,
         params: Params = DEFAULT_PARAMS, plan: str = "auto", active=None, carry=None) -> DataFrame:
    """J5 without the threshold, one row per input row: ``carry`` (default ``keys``) + ``brand_idx,
    brand_name, brand_code, brand_atomic, score, score_text, error``; brand columns are null when
    no brand is eligible or ``active`` (a boolean Column) is false for the row.

    ``text_col`` must be stripped. ``vec_col`` may be null per row (cosine part 0.0).
    The plan is ``broadcast`` when the brand block passes the size check, else ``grid``; both give one
    row per input row, repeated keys included. With ``active``, the rows are written once and only
    the active ones are shuffled to the kernel.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    carry = list(carry) if carry is not None else list(keys)
    w = float(params.vector_weight)
    use_combined = bool(params.use_combined)
    ship_package(texts.sparkSession)
    act = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    act = act & F.coalesce(F.col(text_col) != "", F.lit(False))  # a blank text is never scored
    tx = texts.select(*carry, F.col(text_col).alias("_kt"), F.col(vec_col).cast("array<float>").alias("_kv"),
                      act.alias("_ka"))
    schema = T.StructType([*[texts.schema[c] for c in carry], *_OUT_FIELDS])
    def none(rows):
        return rows.select(*carry, *[F.lit(None).cast(f.dataType).alias(f.name) for f in _OUT_FIELDS])

    index = brands if isinstance(brands, BrandIndex) else None
    if index is None and plan in ("auto", "broadcast"):
        index = prepare_brands(brands, params)
        if index is None and plan == "broadcast":
            raise ValueError("brand table exceeds the broadcast bound; use the grid plan")
    if index is not None:
        if index.n == 0:
            return none(tx)
        if active is None:
            return _top1_broadcast(tx, index, carry, w, use_combined, params, schema)
        tx = materialized(tx)
        return _top1_broadcast(tx.where("_ka"), index, carry, w, use_combined, params, schema).unionByName(none(tx.where(~F.col("_ka"))))
    live = _live_brands(brands)
    stats = live.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"),
                     F.min(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("least")).first()
    n_brands, dim = int(stats["n"]), max(int(stats["d"] or 0), 0)
    if n_brands == 0:
        return none(tx)
    tx = materialized(tx.withColumn("_row", F.monotonically_increasing_id()))
    one_length = stats["least"] is None or stats["least"] == stats["d"]
    on, out = tx.where("_ka"), none(tx.where(~F.col("_ka")))
    if use_combined and one_length and dim and Balls.fits(n_brands, 0, params):
        # to texts without a vector only names count: they have blocks of brands with names alike, the others blocks of near vectors
        plain = F.col("_kv").isNull()
        kinds = on.agg(F.count_if(plain).alias("plain"), F.count_if(~plain).alias("others")).first()
        if kinds["plain"]:
            out = _top1_pruned(on.where(plain), live, carry, 0, w, use_combined, params, schema, n_brands).unionByName(out)
            if not kinds["others"]:
                return out
        on = on.where(~plain)
    grid = _top1_pruned if one_length and Balls.fits(n_brands, dim, params) else _top1_grid
    return grid(on, live, carry, dim, w, use_combined, params, schema, n_brands).unionByName(out)


class BrandIndex:
    """A size-checked brand table prepared once for the broadcast kernel: ids, names, codes,
    code-point matrix and float32 vectors in one broadcast variable. Reusable across
    queries and micro-batches (the stream broadcasts it once, not per batch)."""

    def __init__(self, spark, pdf: pd.DataFrame, dim: int):
        block = _block_from_pandas(pdf, dim)
        block["mat"] = block["mat"].astype(np.float32)
        self.n, self.dim = len(pdf), dim
        self.frame = pdf
        self.bc = spark.sparkContext.broadcast(block)


def prepare_brands(brands: DataFrame, params: Params = DEFAULT_PARAMS) -> "BrandIndex | None":
    """Sizes first (rows, longest vector and name), then one bounded collect. The bytes count all of the
    index: vectors in both precisions, name matrix and histograms. Returns None when the brand
    table is beyond the broadcast bounds (use the grid plan)."""
    live = _live_brands(brands)
    size = live.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"), F.max(F.length("brand_name")).alias("w")).first()
    dim = max(int(size["d"] or 0), 0)
    row_bytes = 12 * dim + 4 * (int(size["w"] or 0) + HIST_BUCKETS)
    if size["n"] > params.max_broadcast_brands or size["n"] * row_bytes > params.max_broadcast_bytes:
        return None
    pdf = live.toPandas()
    return BrandIndex(brands.sparkSession, pdf, dim)


def kernel_partitions(spark, params: Params) -> int:
    """Task count for the Python kernel: its cost is per row, not per byte, so the input is
    hash-partitioned to a fixed count (not coalesced by AQE's byte-based rule): at least two
    tasks per core and at least the shuffle partition count, which ``scale_conf`` sizes from the
    input volume."""
    if params.kernel_partitions:
        return params.kernel_partitions
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2 * spark.sparkContext.defaultParallelism, shuffle, 1)


def _top1_broadcast(tx, index: BrandIndex, carry, w, use_combined, params, schema):
    bc, dim = index.bc, index.dim
    cells = params.kernel_batch_cells
    tx = tx.repartition(kernel_partitions(tx.sparkSession, params), "_kt", "_kv")

    def run(batches):
        blk = dict(bc.value)
        for pdf_ in batches:
            yield _score_frame(pdf_, carry, blk, dim, w, use_combined, cells)

    return tx.mapInPandas(run, schema)


def _cell_scores(texts: DataFrame, brands: DataFrame, dim, w, use_combined, params, n_cells: int = 0) -> DataFrame:
    """(_row, brand fields) of the best brand in each cell: rows of ``texts`` and ``brands`` that share ``_blk`` and ``_tb``. ``n_cells``:
    their number, if known; many are dealt over more tasks, so that none has several while others have none."""
    cells, parts = params.kernel_batch_cells, kernel_partitions(texts.sparkSession, params)
    parts = max(parts, min(2 * n_cells, 4 * parts))
    cell_schema = T.StructType([T.StructField("_row", T.LongType(), False), *_OUT_FIELDS])
    names = cell_schema.fieldNames()

    def cell(tpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if len(tpdf) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        return _score_frame(tpdf, ["_row"], _block_from_pandas(bpdf, dim), dim, w, use_combined, cells)[names]

    # a fixed number of tasks: cells are few bytes and much work, AQE would join them into a few
    texts, brands = (x.repartition(parts, "_blk", "_tb") for x in (texts, brands))
    return texts.groupBy("_blk", "_tb").cogroup(brands.groupBy("_blk", "_tb")).applyInPandas(cell, cell_schema)


def _merged(on: DataFrame, partial: DataFrame, carry) -> DataFrame:
    """The blocks merged: highest score, then lowest brand_idx; an error in any block wins (C4)."""
    best = F.max(F.when(F.col("brand_idx").isNotNull(),
                        F.struct(F.col("score"), (-F.col("brand_idx")).alias("neg"), "brand_name",
                                 "brand_code", "brand_atomic", "score_text")))
    merged = partial.groupBy("_row").agg(best.alias("b"), F.max("error").alias("error"))
    ok = F.col("error").isNull()
    return on.select("_row", *carry).join(merged, "_row").select(
        *carry,
        F.when(ok, -F.col("b.neg")).alias("brand_idx"),
        *[F.when(ok, F.col(f"b.{c}")).alias(c) for c in ("brand_name", "brand_code", "brand_atomic", "score", "score_text")],
        "error")


def _top1_pruned(on, live, carry, dim, w, use_combined, params, schema, n_brands):
    """``on``: materialised rows with a unique ``_row``; only the row id, text and vector travel to the cells."""
    balls = Balls(live, dim, n_brands, params)
    rows = on.select("_row", "_kt", "_kv", "_ka")

    def scored(assigned: DataFrame) -> DataFrame:
        met = assigned.join(rows, "_row")
        size = met.groupBy("_blk").agg(F.count("*").alias("n"), F.sum(F.length("_kt") * 4 + 4 * dim).alias("b"))
        buckets = F.greatest(F.lit(params.grid_buckets).cast("bigint"), F.ceil(F.col("n") / params.text_block_rows),
                             F.ceil(F.col("b") / params.text_block_bytes))
        size = materialized(size.select("_blk", buckets.cast("int").alias("_k")))  # a row per block
        n_cells = int(size.agg(F.sum("_k")).first()[0] or 0)
        size = F.broadcast(size)
        met = met.join(size, "_blk").withColumn("_tb", F.pmod(F.xxhash64("_row"), F.col("_k")).cast("int")).drop("_k")
        dealt = balls.brands.join(size, "_blk").withColumn("_tb", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
        return _cell_scores(met, dealt, dim, w, use_combined, params, n_cells)

    first = materialized(balls.first(rows, params))
    seeds = materialized(scored(first))
    known = seeds.where("error is null").select("_row", F.col("score").alias("_seed"))
    asked = rows.join(known, "_row").join(first.withColumnRenamed("_blk", "_first"), "_row")
    # the first round's score travels along: only names that can reach it are looked at
    reached = materialized(balls.reached(asked, params)).join(known, "_row")
    return _merged(on, seeds.unionByName(scored(reached)), carry)


def _top1_grid(on, live, carry, dim, w, use_combined, params, schema, n_brands):
    """``on``: materialised rows with a unique ``_row``. Every text meets every block. Cells are bounded in rows and, by the mean
    text, in bytes; only the row id, text and vector travel to them, the carried columns are joined back."""
    n_blocks = params.grid_blocks or max(1, math.ceil(n_brands / params.brand_block_rows))
    size = on.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_kt") * 4 + 4 * dim).alias("b")).first()
    n_buckets = max(1, params.grid_buckets, math.ceil(size["n"] / params.text_block_rows),
                    math.ceil((size["b"] or 0) / params.text_block_bytes))
    # both sides must carry the cell keys with the same type, or they hash to different partitions
    t_rep = (on.select("_row", "_kt", "_kv", "_ka").withColumn("_tb", F.pmod(F.xxhash64("_row"), F.lit(n_buckets)).cast("int"))
             .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    b_rep = (live.withColumn("_blk", F.pmod(F.xxhash64("brand_idx"), F.lit(n_blocks)).cast("int"))
             .withColumn("_tb", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1)))))
    return _merged(on, _cell_scores(t_rep, b_rep, dim, w, use_combined, params), carry)


def match_by_similarity(texts: DataFrame, brands: DataFrame, keys, text_col: str, vec_col: str,
                        params: Params = DEFAULT_PARAMS, plan: str = "auto", active=None, carry=None) -> DataFrame:
    """``top1`` with brands below ``similarity_threshold`` cleared (brand columns null)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    carry = list(carry) if carry is not None else list(keys)
    best = top1(texts, brands, keys, text_col, vec_col, params, plan, active, carry)
    keep = F.col("score") >= F.lit(float(params.similarity_threshold))
    return best.select(*carry, *[F.when(keep, F.col(c)).alias(c) for c in _OUT[:-1]], "error")
