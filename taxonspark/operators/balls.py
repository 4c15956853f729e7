"""Brand blocks of small balls, with an exact upper bound of the score that a text can reach in each.

Pivots are picked farthest first from a bounded sample of the brand vectors, and every brand goes to the ball of its nearest
pivot. Balls near each other are packed into blocks of about ``brand_block_rows`` brands (a ball beyond that is split). A ball's
summary is small: centroid and radius, shortest and longest name, the largest count of every character (in buckets) over its
names, and their first characters. For a text ``q . b <= q . centroid + |q| * radius`` bounds the cosine part and the shared
characters bound Jaro-Winkler, so a block whose balls all stay below a score the text has already can't hold its best
brand. Brands without a vector have balls of their own.

For texts without a vector only names count: there a ball is a range of names by their ``likeness``, cut at those of a sample.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import likeness
from ..functions.similarity import BOOST_GATE, HIST_BUCKETS, MAX_PREFIX, PREFIX_WEIGHT, char_histograms, encode_names
from ..functions.text import PY_WHITESPACE, strip
from ..params import Params
from ..session import materialized, ship_package

#: room for rounding in the bounds; scores are in [0, 1]
SLACK = 1e-9
#: balls a block on average, balls in all, and sampled vectors a pivot
PER_BLOCK, MAX_BALLS, SAMPLE = 32, 4096, 4
#: characters of a name that tell its range; (text, ball) bounds made together
KEY, CELLS = 256, 500_000
_SUMMARY = "_blk long, centroid array<double>, radius double, shortest int, longest int, hist array<int>, firsts array<int>"


def _rows(vectors, dim: int) -> np.ndarray:
    """The vectors of length ``dim`` as rows; others are NaN (no vector)."""
    out = np.full((len(vectors), dim), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def _summary(key, pdf: pd.DataFrame, dim: int) -> pd.DataFrame:
    vecs = [v for v in pdf["embedding"] if v is not None]
    mat, lens = encode_names([str(x) for x in pdf["brand_name"]])
    m = _rows(vecs, dim)
    centre = m.mean(axis=0) if vecs else np.zeros(dim)
    radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1)).max()) if vecs else 0.0
    firsts = np.unique(mat[lens > 0, 0] % HIST_BUCKETS)
    return pd.DataFrame({"_blk": [key[0]], "centroid": [centre.tolist() if vecs else None], "radius": [radius], "shortest": [int(lens.min())],
                         "longest": [int(lens.max())], "hist": [char_histograms(mat, lens).max(axis=0).tolist()], "firsts": [firsts.tolist()]})


def _farthest_first(m: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` distinct rows of ``m``, each the farthest from those before."""
    if not len(m):
        return m
    gap, picked = np.full(len(m), np.inf), [0]
    while len(picked) < k:
        gap = np.minimum(gap, ((m - m[picked[-1]]) ** 2).sum(axis=1))
        if gap.max() <= 0:
            break
        picked.append(int(gap.argmax()))
    return m[picked]


def _packed(pivots: np.ndarray, counts: dict[int, int], blocks: int, rows: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks that the ball is split over) of each ball: balls that share their nearest of the first ``blocks`` pivots
    follow each other and fill a block up to ``rows`` brands."""
    coarse = pivots[:blocks]
    near = ((pivots ** 2).sum(axis=1)[:, None] + (coarse ** 2).sum(axis=1) - 2 * pivots @ coarse.T).argmin(axis=1) if len(pivots) else []
    out, block, filled = {}, 0, 0
    for ball in sorted(counts, key=lambda b: (near[b] if 0 <= b < len(pivots) else -1, b)):
        n = counts[ball]
        if filled and filled + n > rows:
            block, filled = block + 1, 0
        parts = max(1, -(-n // rows))
        out[ball] = (block, parts)
        block, filled = (block, filled + n) if parts == 1 else (block + parts, 0)
    return out


def _balls(blocks: int) -> int:
    return max(16, min(MAX_BALLS, PER_BLOCK * blocks))


class Balls:
    """``brands`` with their block ``_blk``, and the balls' summaries as one broadcast. ``dim`` 0: by names, vectors are left out."""

    def __init__(self, live: DataFrame, dim: int, n: int, params: Params):
        spark = live.sparkSession
        ship_package(spark)
        live = live if dim else live.withColumn("embedding", F.lit(None).cast("array<float>"))
        want = params.grid_blocks or max(1, -(-n // params.brand_block_rows))
        rows = max(1, -(-n // params.grid_blocks) if params.grid_blocks else params.brand_block_rows)
        deal, pivots = self._by_names(live, want) if dim == 0 else self._by_vectors(live, dim, want)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in live.schema) + ", _ball long"
        dealt = materialized(live.mapInPandas(deal, schema))
        counts = {r["_ball"]: r["count"] for r in dealt.groupBy("_ball").count().collect()}  # a row per pivot
        place = [(ball, *at) for ball, at in _packed(pivots, counts, want, rows).items()]
        place = F.broadcast(spark.createDataFrame(place, "_ball long, _first long, _parts long"))
        blk = F.col("_first") + F.pmod(F.xxhash64("brand_idx"), F.col("_parts"))
        self.brands = materialized(dealt.join(place, "_ball").withColumn("_blk", blk).drop("_first", "_parts"))
        found = self.brands.groupBy("_blk", "_ball").applyInPandas(lambda key, pdf: _summary(key, pdf, dim), _SUMMARY).toPandas().sort_values("_blk", kind="stable")
        self.brands = self.brands.drop("_ball")
        has = found["centroid"].notna().to_numpy()
        centres = np.zeros((len(found), dim))
        centres[has] = _rows(list(found["centroid"][has]), dim)
        firsts = np.zeros((len(found), HIST_BUCKETS), bool)
        for i, f in enumerate(found["firsts"]):
            firsts[i, list(f)] = True
        blk, starts = np.unique(found["_blk"].to_numpy(np.int64), return_index=True)
        self.n, self.dim = len(blk), dim
        self.summary = spark.sparkContext.broadcast({
            "blk": blk, "starts": starts, "has": has, "centre": centres, "radius": found["radius"].to_numpy(float),
            "shortest": found["shortest"].to_numpy(float), "longest": found["longest"].to_numpy(float),
            "hist": np.stack([np.asarray(h, np.int64) for h in found["hist"]]), "firsts": firsts})

    @staticmethod
    def _by_vectors(live: DataFrame, dim: int, want: int):
        """What adds ``_ball`` to batches of brands, and the pivots."""
        usable = live.where(F.col("embedding").isNotNull())
        picked = usable.orderBy(F.xxhash64("brand_idx"), "brand_idx").select("embedding").limit(SAMPLE * _balls(want)).collect()  # see ``fits``
        picked = _rows([r.embedding for r in picked], dim)
        pivots = _farthest_first(picked[np.isfinite(picked).all(axis=1)], _balls(want))
        shared = live.sparkSession.sparkContext.broadcast(pivots)

        def nearest(batches):
            p = shared.value
            half = (p ** 2).sum(axis=1) / 2
            for pdf in batches:
                has = pdf["embedding"].notna().to_numpy()
                ball = np.full(len(pdf), -1, np.int64)
                if has.any():
                    ball[has] = 0
                    if len(p):
                        gap = _rows(list(pdf["embedding"][has]), dim) @ p.T - half
                        ball[has] = np.where(np.isnan(gap), -np.inf, gap).argmax(axis=1)
                yield pdf.assign(_ball=ball)

        return nearest, pivots

    @staticmethod
    def _by_names(live: DataFrame, want: int):
        picked = live.orderBy(F.xxhash64("brand_idx"), "brand_idx").select(F.substring(strip("brand_name"), 1, KEY).alias("n")).limit(SAMPLE * _balls(want))
        cuts = sorted(likeness(r.n) for r in picked.collect())[SAMPLE::SAMPLE]
        shared = live.sparkSession.sparkContext.broadcast(cuts)

        def ranged(batches):
            for pdf in batches:
                yield pdf.assign(_ball=np.array([bisect_right(shared.value, likeness(str(x).strip(PY_WHITESPACE)[:KEY])) for x in pdf["brand_name"]], np.int64))

        return ranged, np.empty((0, 0))

    @staticmethod
    def fits(n: int, dim: int, params: Params) -> bool:
        """Whether the pivots' sample and the summaries stay within the broadcast bound."""
        blocks = params.grid_blocks or max(1, -(-n // params.brand_block_rows))
        return max(SAMPLE * _balls(blocks) * 8 * dim, (2 * blocks + _balls(blocks)) * (8 * dim + 9 * HIST_BUCKETS)) <= params.max_broadcast_bytes

    def first(self, texts: DataFrame, params: Params) -> DataFrame:
        """(_row, _blk): the block of the highest bound for each row of ``texts`` (_row, _kt, _kv)."""
        def pick(pdf, ub):
            return pdf["_row"], ub.argmax(axis=1)
        return self._map(texts.select("_row", "_kt", "_kv"), params, pick)

    def reached(self, texts: DataFrame, params: Params) -> DataFrame:
        """(_row, _blk): the other blocks whose bound reaches the score ``_seed`` (null: any) of the block ``_first``."""
        def pick(pdf, ub):
            seed = pdf["_seed"].to_numpy(float)
            ok = ub >= np.where(np.isnan(seed), -np.inf, seed)[:, None]
            ok &= blocks.value["blk"][None, :] != pdf["_first"].to_numpy()[:, None]
            row, at = np.nonzero(ok)
            return pdf["_row"].to_numpy()[row], at
        blocks = self.summary
        return self._map(texts.select("_row", "_kt", "_kv", "_seed", "_first"), params, pick)

    def _map(self, texts: DataFrame, params: Params, pick) -> DataFrame:
        blocks, dim, w, both, cells = self.summary, self.dim, float(params.vector_weight), bool(params.use_combined), params.kernel_batch_cells

        def run(batches):
            s = blocks.value
            step = max(1, min(cells, CELLS) // max(1, len(s["has"])))
            for whole in batches:
                for lo in range(0, len(whole), step):
                    pdf = whole.iloc[lo:lo + step]
                    row, at = pick(pdf, upper_bounds(list(pdf["_kt"]), list(pdf["_kv"]), s, dim, w, both))
                    yield pd.DataFrame({"_row": np.asarray(row, np.int64), "_blk": s["blk"][at]})

        return texts.mapInPandas(run, "_row long, _blk long")


def upper_bounds(texts: list, vectors: list, s: dict, dim: int, w: float, use_combined: bool) -> np.ndarray:
    """An upper bound of the score in every block (columns) for each text: that of its best ball; infinite where a NaN hides it."""
    q = _rows(vectors, dim)
    absent = np.array([v is None or len(v) != dim for v in vectors])
    q[absent] = 0.0
    with np.errstate(invalid="ignore"):
        cos = (q @ s["centre"].T + np.sqrt((q ** 2).sum(axis=1))[:, None] * s["radius"][None, :] + 1.0) / 2.0
    cos[:, ~s["has"]] = 0.0
    cos[absent, :] = 0.0
    if not use_combined:
        out = cos
    else:
        out = w * cos + (1.0 - w) * _name_bounds(texts, s)
    return np.maximum.reduceat(np.where(np.isnan(out), np.inf, out), s["starts"], axis=1) + SLACK


def _name_bounds(texts: list, s: dict) -> np.ndarray:
    """An upper bound of Jaro-Winkler between each text (rows) and any name of each ball."""
    counts, lens, first = np.zeros((len(texts), HIST_BUCKETS), np.float32), np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        av = np.frombuffer((text or "").strip(PY_WHITESPACE).encode("utf-32-le"), np.int32)
        if len(av):
            counts[i] = np.bincount(av % HIST_BUCKETS, minlength=HIST_BUCKETS)
            lens[i], first[i] = len(av), av[0] % HIST_BUCKETS
    # min(a, b) of two counts is the number of levels that both reach
    shared = np.zeros((len(texts), len(s["has"])))
    for level in range(1, int(min(counts.max(initial=0), s["hist"].max(initial=0))) + 1):
        shared += (counts >= level).astype(np.float32) @ (s["hist"] >= level).astype(np.float32).T
    length = np.clip(shared, s["shortest"], s["longest"])  # where m / |a| + m / |b| is largest for m = min(shared, |b|)
    m = np.minimum(shared, length)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where((m > 0) & (length > 0), (m / lens + m / length + 1.0) / 3.0, 0.0)
    prefix = np.where(s["firsts"][:, first].T, np.minimum(MAX_PREFIX, np.minimum(lens, s["longest"])), 0)
    return np.where(sim > BOOST_GATE, sim + prefix * PREFIX_WEIGHT * (1.0 - sim), sim)
