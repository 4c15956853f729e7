"""A keyword dictionary of any size, partitioned by q-grams.

Every keyword is filed under its first ``REACH`` characters: all of it, unless it is longer. Texts are scanned once: a place is looked at if
its first characters may begin a keyword, and the q-grams there, of each length that some keyword has, are tested against a
broadcast Bloom filter of the filed ones (of bounded size). What passes is shuffled once per text, however often the text has
it, and meets the keywords filed under the same characters. No keyword passes through the driver or is held by a task
as a whole dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized, ship_package

#: characters that a place is judged by first; shorter keywords are looked for at every place
GRAM = 4
#: characters that a keyword is filed under; what a longer keyword has beyond is compared on the whole text
REACH = 64
#: bits of the filter for a fingerprint, and for the whole dictionary (32 MB): a fuller filter lets more through, no less
BITS, MAX_BITS = 16, 1 << 28
_BLOB = 16  # log2 of the bits of a piece of the filter
_PIECE = 1 << 18  # characters hashed at once
#: the base of the fingerprints, and its inverse modulo 2^64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Grams:
    """Fingerprints of any run of ``points``, from sums over all of them."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        x = _mixed(points.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * _powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def at(self, places: np.ndarray, size) -> np.ndarray:
        """Those of the runs of ``size`` at ``places``."""
        run = (self.sums[places + size] - self.sums[places]) * self.back[places]
        return _mixed(run + np.asarray(size).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))


def _laid_out(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after the other, and their bounds."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *map(len, strings)])


def _pieces(strings: list[str]):
    """Runs of strings of about ``_PIECE`` characters."""
    lo, n = 0, 0
    for hi, s in enumerate(strings, 1):
        n += len(s)
        if n >= _PIECE or hi == len(strings):
            yield lo, strings[lo:hi]
            lo, n = hi, 0


def _fingerprints(batches):
    """mapInArrow (piece) -> (fp): those of every piece and, inverted, of the first ``GRAM`` characters of the longer ones."""
    for b in batches:
        for _, some in _pieces(b.column(0).to_pylist()):
            points, bounds = _laid_out(some)
            lengths, grams = np.diff(bounds), Grams(points)
            begun = bounds[:-1][lengths > GRAM]
            fp = np.concatenate([grams.at(bounds[:-1], lengths), ~grams.at(begun, GRAM)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(fp).view(np.int64))], ["fp"])


def _filter_pieces(batches):
    """mapInArrow (bit), dealt by piece -> (piece, blob)."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        bits = np.unique(b.column(0).to_numpy())
        for piece in np.unique(bits >> _BLOB).tolist():
            blob = found.setdefault(piece, np.zeros(1 << _BLOB, bool))
            blob[bits[bits >> _BLOB == piece] & ((1 << _BLOB) - 1)] = True
    for piece, blob in found.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "blob": pa.array([np.packbits(blob, bitorder="little").tobytes()], pa.binary())})


class KeywordGrams:
    """The dictionary: ``entries`` (piece, kid, whole) of the keywords ``kw`` (kid, kw), and the filter of their fingerprints."""

    def __init__(self, kw: DataFrame):
        self.spark = kw.sparkSession
        ship_package(self.spark)
        self.keywords = kw
        piece = F.substring("kw", 1, REACH)
        self.entries = materialized(kw.where(F.col("kw") != "").select(piece.alias("piece"), "kid", (piece == F.col("kw")).alias("whole")))
        seen = self.entries.agg(F.collect_set(F.char_length("piece")).alias("sizes"), F.count_if(~F.col("whole")).alias("cut")).first()
        self.sizes, self.cut = sorted(seen["sizes"]), seen["cut"]
        self.filter = self.spark.sparkContext.broadcast(self._filter())

    def _filter(self) -> np.ndarray:
        """The Bloom filter, of ``BITS`` bits a fingerprint and two hashes, as packed bytes; made in pieces by the tasks."""
        fps = materialized(self.entries.select("piece").mapInArrow(_fingerprints, "fp long").distinct())
        n, bits = fps.count(), 1 << _BLOB
        while bits < min(MAX_BITS, BITS * n):
            bits *= 2
        fp = F.col("fp")
        marks = fps.select(F.explode(F.array(fp, F.shiftrightunsigned(fp, 32))).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("bit"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        pieces = marks.distinct().repartition(parts, F.shiftright("bit", _BLOB)).mapInArrow(_filter_pieces, "piece long, blob binary")
        out = np.zeros(bits // 8, np.uint8)
        for r in pieces.toLocalIterator():  # at most MAX_BITS in all
            at = r.piece << _BLOB - 3
            out[at:at + (1 << _BLOB - 3)] = np.frombuffer(r.blob, np.uint8)
        return out

    def hits(self, texts: DataFrame) -> DataFrame:
        """(row, kid) of ``texts`` (row: long, unique; text): the keywords that each text contains, once each."""
        found = texts.select("row", "text").mapInArrow(_scanner(self.filter, self.sizes), "row long, piece string")
        met = found.join(self.entries, "piece")  # the characters themselves: what only looked like a keyword to the filter goes here
        if not self.cut:
            return met.select("row", "kid")
        met = materialized(met.select("row", "kid", "whole"))
        long = met.where("not whole").select("row", "kid").join(texts, "row").join(self.keywords, "kid")
        return met.where("whole").select("row", "kid").unionByName(long.where(F.contains("text", "kw")).select("row", "kid"))


def _scanner(bloom, sizes: list[int]):
    """mapInArrow (row, text) -> (row, piece): runs of the ``sizes`` that the filter knows, once for each text."""
    def scan(batches):
        bits = bloom.value
        mask = np.uint64(8 * len(bits) - 1)

        def known(h: np.ndarray) -> np.ndarray:
            """The places in ``h`` of what the filter knows."""
            at = np.arange(len(h))
            for shift in (np.uint64(0), np.uint64(32)):
                b = (h[at] >> shift) & mask
                at = at[bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0]
            return at

        for b in batches:
            rows, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for lo, some in _pieces(texts):
                points, bounds = _laid_out(some)
                grams, end = Grams(points), np.repeat(bounds[1:], np.diff(bounds))
                every = np.arange(len(points))
                begun = every[every + GRAM <= end]
                begun = begun[known(~grams.at(begun, GRAM))] if sizes and sizes[-1] > GRAM else begun
                for size in sizes:
                    at = every if size <= GRAM else begun
                    at = at[at + size <= end[at]]
                    fp = grams.at(at, size)
                    ok = known(fp)
                    if len(ok):
                        text, piece, shown = _once(points, bounds, at[ok], fp[ok], size)
                        runs = pa.array([points[p:p + size].tobytes().decode("utf-32-le", "surrogatepass") for p in shown.tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(rows[lo + text]), runs.take(pa.array(piece))], ["row", "piece"])
    return scan


def _once(points, bounds, at, fp, size: int):
    """(text, place in ``shown``) of the runs of ``size`` at ``at``, each run once for a text; ``shown``: a place of each run."""
    _, first, run = np.unique(fp, return_index=True, return_inverse=True)
    shown = at[first]
    same = np.ones(len(at), bool)
    for k in range(size):
        same &= points[at + k] == points[shown[run] + k]
    if not same.all():  # other characters of an equal fingerprint: runs of their own
        other = np.flatnonzero(~same)
        run[other] = len(shown) + np.arange(len(other))
        shown = np.append(shown, at[other])
    text = np.searchsorted(bounds, at, "right") - 1
    pairs = np.unique(text * len(shown) + run)
    return pairs // len(shown), pairs % len(shown), shown
