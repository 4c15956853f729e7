"""Similarity functions: Jaro-Winkler on code points, cosine on vectors, blends.

Cosine and the blends are Column arithmetic (JVM-side). Jaro-Winkler has no Spark
built-in, so it is a small pure-Python routine used (a) vectorised per Arrow batch by
``jaro_winkler_udf`` and (b) inside the top-1 kernel of ``operators.similarity``
where it is only evaluated for candidates that survive a cosine upper bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PY_WHITESPACE, strip

# The published Jaro-Winkler parameters the results must match
# (prefix weight 0.1, at most 4 prefix characters, boost only when Jaro exceeds 0.7).
PREFIX_WEIGHT = 0.1
MAX_PREFIX = 4
BOOST_GATE = 0.7


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two non-empty strings, compared by code point."""
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    if a == b:
        return 1.0
    window = max(max(la, lb) // 2 - 1, 0)
    used_b = [False] * lb
    hits_a = []
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not used_b[j] and b[j] == ch:
                used_b[j] = True
                hits_a.append(ch)
                break
    m = len(hits_a)
    if m == 0:
        return 0.0
    hits_b = [b[j] for j in range(lb) if used_b[j]]
    mismatched = sum(1 for x, y in zip(hits_a, hits_b) if x != y)
    t = mismatched // 2  # integer halving, as in the published implementation
    return (m / la + m / lb + (m - t) / m) / 3.0


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Strip both; blank side -> 0.0; prefix boost (<= 4 chars, 0.1) only above 0.7."""
    a = (a or "").strip(PY_WHITESPACE)
    b = (b or "").strip(PY_WHITESPACE)
    if not a or not b:
        return 0.0
    sim = jaro(a, b)
    if sim > BOOST_GATE:
        prefix = 0
        for x, y in zip(a[:MAX_PREFIX], b[:MAX_PREFIX]):
            if x != y:
                break
            prefix += 1
        sim += prefix * PREFIX_WEIGHT * (1.0 - sim)
    return sim


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched Jaro-Winkler over two string columns."""
    return pd.Series(jaro_winkler_pairs(list(a), list(b)), dtype="float64")


def weighted(cos01, jw, w: float) -> Column:
    """``w * cos01 + (1 - w) * jw``."""
    return F.lit(float(w)) * cos01 + F.lit(1.0 - float(w)) * jw


def cos01(cos) -> Column:
    """Map cosine [-1, 1] to [0, 1]."""
    return (cos + F.lit(1.0)) / F.lit(2.0)


def dot(a, b) -> Column:
    """Dot product of two float arrays, accumulated in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a, b, text_a=None, text_b=None) -> Column:
    """Dot of L2-normalised vectors; a blank text on either side gives 0.0."""
    d = dot(a, b)
    if text_a is not None and text_b is not None:
        d = F.when((strip(text_a) == "") | (strip(text_b) == ""), F.lit(0.0)).otherwise(d)
    return d


def cosine01_text(a, b, text_a, text_b) -> Column:
    """cos01 of E9, so a blank text yields 0.5."""
    return cos01(cosine(a, b, text_a, text_b))


def clamp01(c) -> Column:
    """Scores are kept inside [0, 1] (double arithmetic can overshoot by an ulp)."""
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def combined_similarity(vec_a, vec_b, text_a, text_b, w: float | None = 0.5,
                        use_combined: bool = True) -> Column:
    """Blend of E10 and E6 for pairs; ``use_combined=False`` gives E10 only."""
    w = 0.5 if w is None else w
    c = cosine01_text(vec_a, vec_b, text_a, text_b)
    if not use_combined:
        return c
    ta = F.col(text_a) if isinstance(text_a, str) else text_a
    tb = F.col(text_b) if isinstance(text_b, str) else text_b
    return weighted(c, jaro_winkler_udf(ta, tb), w)


def encode_names(names: list[str]) -> tuple:
    """Code-point matrix (n, L) padded with -1, plus lengths, for ``jaro_winkler_many``.

    Names are stripped first (E6 strips both sides)."""
    import numpy as np
    stripped = [(x or "").strip(PY_WHITESPACE) for x in names]
    lens = np.array([len(x) for x in stripped], dtype=np.int64)
    width = int(lens.max()) if len(stripped) else 0
    mat = np.full((len(stripped), max(width, 1)), -1, dtype=np.int32)
    mat[np.arange(mat.shape[1])[None, :] < lens[:, None]] = np.frombuffer("".join(stripped).encode("utf-32-le"), dtype=np.int32)
    return mat, lens


CELLS = 4_000_000  # names x width cells that one numpy step works on


def jaro_winkler_pairs(a: list, b: list):
    """E6 of many (text, text) pairs, a numpy block of pairs of similar length at a time."""
    import numpy as np
    out = np.zeros(len(a), dtype=np.float64)
    ma, la = encode_names(a) if max(map(len, (x or "" for x in a)), default=0) <= 4096 else (None, None)
    if ma is None:  # a block would be as wide as its longest text: such texts go one by one
        for i, (x, y) in enumerate(zip(a, b)):
            out[i] = jaro_winkler_many(x, *encode_names([y]))[0]
        return out
    order = np.lexsort((la, np.array([len(y or "") for y in b])))
    lo = 0
    while lo < len(a):
        hi = min(len(a), lo + 4096)
        rows = order[lo:hi]
        mb, lb = encode_names([b[i] for i in rows])
        rows_per = max(1, CELLS // max(1, mb.shape[1]))
        if len(rows) > rows_per:
            hi, rows, mb, lb = lo + rows_per, rows[:rows_per], mb[:rows_per], lb[:rows_per]
        out[rows] = _jaro_winkler_rows(ma[rows], la[rows], mb, lb)
        lo = hi
    return out


def _jaro_winkler_rows(ma, la, mb, lb):
    """Row-wise greedy window matching: step i matches character i of every left text at once."""
    import numpy as np
    n, width = mb.shape
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    p = min(MAX_PREFIX, ma.shape[1], width)
    if width < 64:
        m, t = _matched_bits(ma, la, mb, window)
        return _jaro_winkler(la, lb, m, t, (ma[:, :p] == mb[:, :p]) & (ma[:, :p] >= 0))
    cols, used = np.arange(width), np.zeros((n, width), dtype=bool)
    seq, m = np.full((n, width), -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(int(la.max(initial=0))):
        cand = ((mb == ma[:, i, None]) & ~used & (cols >= (i - window)[:, None]) & (cols <= (i + window)[:, None])
                & (cols < lb[:, None]) & (i < la)[:, None])
        r = np.flatnonzero(cand.any(axis=1))
        used[r, cand[r].argmax(axis=1)] = True
        seq[r, m[r]] = ma[r, i]
        m[r] += 1
    return _winkler(la, lb, mb, used, seq, m, (ma[:, :p] == mb[:, :p]) & (ma[:, :p] >= 0))


def _matched_bits(ma, la, mb, window):
    """Matches and half transpositions of each row; the places of a name (fewer than 64) are the bits of a number."""
    import numpy as np
    n, width = mb.shape
    steps, one = int(la.max(initial=0)), np.uint64(1)
    used, matched = np.zeros(n, dtype=np.uint64), np.zeros((steps, n), dtype=bool)
    ma = np.where(ma < 0, -2, ma)  # the padding of a text is not that of a name
    per = max(1, CELLS // (64 * max(1, n)))
    for lo in range(0, steps, per):
        hi = min(steps, lo + per)
        same = np.zeros((hi - lo, n, 64), dtype=bool)
        same[:, :, :width] = ma[:, lo:hi].T[:, :, None] == mb[None, :, :]
        same = np.packbits(same, axis=2, bitorder="little").view("<u8")[:, :, 0]
        for i in range(lo, hi):
            found = same[i - lo] & ~used
            found &= (one << np.minimum(i + window + 1, 63).astype(np.uint64)) - one
            found &= ~((one << np.clip(i - window, 0, 63).astype(np.uint64)) - one)
            found &= ~found + one  # the first of them
            used |= found
            matched[i] = found != 0
    # row by row as many characters on both sides, in their orders
    row, at = np.nonzero(matched.T)
    right = mb[np.unpackbits(used.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width].astype(bool)]
    return matched.sum(axis=0), np.bincount(row[ma[row, at] != right], minlength=n) // 2


def _winkler(la, lens, mat, used, seq, m, same):
    """The score from the matched characters: ``seq`` and ``m`` on the left, ``used`` on the right."""
    import numpy as np
    right = np.take_along_axis(mat, np.argsort(~used, axis=1, kind="stable"), axis=1)
    valid = np.arange(mat.shape[1])[None, :] < m[:, None]
    return _jaro_winkler(la, lens, m, ((seq != right) & valid).sum(axis=1) // 2, same)


def _jaro_winkler(la, lens, m, t, same):
    """The score from matches, half transpositions, lengths and equal beginnings."""
    import numpy as np
    mf = m.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (mf / la + mf / lens + (mf - t) / mf) / 3.0
    sim = np.where((m > 0) & (lens > 0), sim, 0.0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(sim > BOOST_GATE, sim + prefix * PREFIX_WEIGHT * (1.0 - sim), sim)


def jaro_winkler_many(a: str | None, mat, lens):
    """E6 of one text against many names at once (numpy, exact same arithmetic as ``jaro_winkler``).

    Step i matches character i of the text in all names. A character that no name has any more, and
    all beyond the last position that a window reaches, cost nothing, so a long text costs about as
    much as its first hits. Names are taken ``CELLS`` cells at a time."""
    import numpy as np
    a = (a or "").strip(PY_WHITESPACE)
    n, width = mat.shape
    if not a or not n:
        return np.zeros(n, dtype=np.float64)
    if n > 1 and n * width > CELLS:
        rows = max(1, CELLS // width)
        return np.concatenate([jaro_winkler_many(a, mat[k:k + rows], lens[k:k + rows]) for k in range(0, n, rows)])
    av, la = np.frombuffer(a.encode("utf-32-le"), dtype=np.int32), len(a)
    window = np.maximum(np.maximum(la, lens) // 2 - 1, 0)
    cols, used = np.arange(width), np.zeros((n, width), dtype=bool)
    seq, m = np.full((n, width), -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
    reach = min(la, int((lens + window).max(initial=0)))
    everywhere = int(window.min())  # up to here each window covers its name from the start
    alive = set(np.unique(mat).tolist())
    inside = cols[None, :] < lens[:, None]
    for i in np.flatnonzero(np.isin(av[:reach], mat)):
        c = int(av[i])
        if c not in alive:
            continue
        left = (mat == c) & ~used & inside
        if not left.any():
            alive.discard(c)
            if not alive:
                break
            continue
        cand = left if i <= everywhere and i + everywhere >= width else (
            left & (cols >= (i - window)[:, None]) & (cols <= (i + window)[:, None]))
        r = np.flatnonzero(cand.any(axis=1))
        used[r, cand[r].argmax(axis=1)] = True
        seq[r, m[r]] = c
        m[r] += 1
    p = min(MAX_PREFIX, la, width)
    return _winkler(la, lens, mat, used, seq, m, mat[:, :p] == av[None, :p])


HIST_BUCKETS = 256


def char_histograms(mat, lens):
    """Per-name character counts in ``HIST_BUCKETS`` buckets (code point modulo the bucket
    count). Bucketing only loosens the bound below: min(a1 + a2, b1 + b2) >= min(a1, b1) + min(a2, b2)."""
    import numpy as np
    n, width = mat.shape
    hist = np.zeros((n, HIST_BUCKETS), dtype=np.int32)
    valid = np.arange(width)[None, :] < lens[:, None]
    rows = np.broadcast_to(np.arange(n)[:, None], mat.shape)[valid]
    np.add.at(hist, (rows, mat[valid] % HIST_BUCKETS), 1)
    return hist


def jaro_winkler_upper(a: str | None, mat, lens, hist=None):
    """An upper bound of ``jaro_winkler_many`` from character counts only: matches cannot
    exceed the shared multiset of characters, transpositions are at least 0, and the prefix
    boost uses the exact common prefix. Equal to the true value whenever the bound's matches
    are all realised without transpositions (same formula, same rounding)."""
    import numpy as np
    a = (a or "").strip(PY_WHITESPACE)
    n = mat.shape[0]
    la = len(a)
    if la == 0 or n == 0:
        return np.zeros(n, dtype=np.float64)
    av = np.frombuffer(a.encode("utf-32-le"), dtype=np.int32)
    if hist is not None:
        buckets, counts = np.unique(av % HIST_BUCKETS, return_counts=True)
        m = np.minimum(hist[:, buckets], counts[None, :]).sum(axis=1)
    else:
        chars, counts = np.unique(av, return_counts=True)
        m = np.zeros(n, dtype=np.int64)
        for ch, ca in zip(chars, counts):
            m += np.minimum((mat == ch).sum(axis=1), ca)
    m = np.minimum(m, np.minimum(la, lens))
    mf = m.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (mf / la + mf / lens + (mf - 0) / mf) / 3.0
    sim = np.where((m > 0) & (lens > 0), sim, 0.0)
    width = mat.shape[1]
    p = min(MAX_PREFIX, la, width)
    prefix = np.cumprod(mat[:, :p] == av[None, :p], axis=1).sum(axis=1) if p > 0 else np.zeros(n, dtype=np.int64)
    boosted = sim + prefix * PREFIX_WEIGHT * (1.0 - sim)
    return np.where(sim > BOOST_GATE, boosted, sim)
