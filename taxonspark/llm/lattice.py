"""Embedding near-duplicates by E8 lattice hashing.

Every table projects a vector to 8 dimensions (fixed Gaussian directions, scaled and shifted) and decodes
it to the nearest point of the E8 lattice; the vector is filed under that cell and its ``probes``
nearest neighbouring cells (of the 240). Vectors of a label that meet in any cell are compared by
cosine in double precision, and a pair counts only in the least cell that it shares, so
nothing is counted twice and no pair leaves a task: tasks return link counts and spanning links.

Equal vectors are one class with a count from the start. A cell with more than ``block`` classes is dealt
into blocks, each pair of blocks being one bounded group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, small_broadcast, staged, workers


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    e = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    k = np.abs(e[odd]).argmax(axis=1)
    r[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: the closer of the decodings to D8 and to D8 + 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def cells(x: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Cell hashes (n x tables * (1 + probes), int64) of unit vectors; ``salt`` keeps labels apart."""
    near, out = _minimal_vectors(), []
    for t in range(tables):
        rng = np.random.default_rng([x.shape[1], t])
        y = x @ (rng.standard_normal((x.shape[1], 8)) * scale) + rng.uniform(0, 2, 8)
        c = nearest_e8(y)
        best = np.argsort(-((y - c) @ near.T), axis=1, kind="stable")[:, :probes]
        for point in [c, *(c + near[best[:, k]] for k in range(probes))]:
            h = mix64(salt + np.uint64(t + 1))
            for col in np.rint(2 * point).astype(np.int64).view(np.uint64).T:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + col)
            out.append(h.view(np.int64))
    return np.stack(out, axis=1)


def _encode(tables: int, probes: int, scale: float):
    """mapInArrow (id, label hash, n, vector) -> the same with the vector's cells; unusable vectors have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = [np.asarray(v, np.float64) for v in b.column(3).to_pylist()]
            codes: list = [() for _ in vecs]
            salt = b.column(1).to_numpy().view(np.uint64)
            for d in {len(v) for v in vecs} - {0}:
                at = np.array([i for i, v in enumerate(vecs) if len(v) == d])
                x = np.stack([vecs[i] for i in at])
                for i, c in zip(at, cells(x / np.linalg.norm(x, axis=1, keepdims=True), salt[at], tables, probes, scale), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int64()))], [*b.schema.names, "cells"])
    return run


def _links(sim: np.ndarray, codes: np.ndarray, key: int, threshold: float, a: np.ndarray, b: np.ndarray):
    """Among rows a x b: the linked pairs, and whether ``key`` is the least cell they share."""
    i, j = np.nonzero(sim >= threshold)
    i, j = a[i], b[j]
    own = np.zeros(len(i), bool)
    for lo in range(0, len(i), 8192):
        p, q = codes[i[lo:lo + 8192]], codes[j[lo:lo + 8192]]
        shared = (p[:, :, None] == q[:, None, :]).any(axis=2)
        own[lo:lo + 8192] = np.where(shared, p, np.iinfo(np.int64).max).min(axis=1) == key
    return i, j, own


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that links reach, for every row (by min-propagation and pointer jumping)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _group(cols: dict, key: int, i: int, j: int, threshold: float):
    """(ids, links that count here, least id of the local component) of the linked rows of one group."""
    order = np.argsort(cols["id"], kind="stable")
    ids, n, side = cols["id"][order], cols["n"][order], cols["g"][order]
    starts, ends = cols["at"][:-1][order], cols["at"][1:][order]
    codes, dims, found = cols["cells"][order], (ends - starts), []
    for d in np.unique(dims):
        a = np.flatnonzero((dims == d) & (side == i))
        b = np.flatnonzero((dims == d) & (side == j)) if i != j else a
        if len(a) and len(b) and (i != j or len(a) > 1):
            xa = cols["v"][starts[a][:, None] + np.arange(d)]
            xb = cols["v"][starts[b][:, None] + np.arange(d)] if i != j else xa
            sim = (xa @ xb.T) / np.outer(np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1))
            if i == j:
                sim[np.tril_indices(len(a))] = -2.0
            if sim.max() >= threshold:
                found.append(_links(sim, codes, key, threshold, a, b))
    if not found:
        return None
    p, q, own = (np.concatenate(c) for c in zip(*found, strict=True))
    links = np.bincount(p[own], n[q[own]], len(ids)) + np.bincount(q[own], n[p[own]], len(ids))
    root, linked = ids[_roots(len(ids), p, q)], np.union1d(p, q)
    return ids[linked], links[linked].astype(np.int64), root[linked]


def _compare(threshold: float, width: int):
    """mapInArrow over rows sorted by (cell, i, j): (id, links found here, least id of the local
    component). Only the last, unfinished group of a batch is held over to the next."""
    def columns(b: pa.RecordBatch) -> dict:
        v, cells = b.column("v"), b.column("cells")
        return {**{c: b.column(c).to_numpy() for c in ("cell", "i", "j", "id", "n", "g")},
                "v": v.flatten().to_numpy(), "at": np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy()))),
                "cells": cells.flatten().to_numpy().reshape(-1, width)}

    def rows(c: dict, lo: int, hi: int) -> dict:
        at = c["at"][lo:hi + 1]
        return {k: x[at[0]:at[-1]] if k == "v" else at - at[0] if k == "at" else x[lo:hi] for k, x in c.items()}

    def join(a: dict, b: dict) -> dict:
        return {k: np.concatenate((a[k], a[k][-1] + b[k][1:])) if k == "at" else np.concatenate((a[k], b[k])) for k in b}

    def finished(c: dict, ends: np.ndarray) -> pa.RecordBatch | None:
        out = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if hi - lo > 1:
                got = _group(rows(c, lo, hi), c["cell"][lo], c["i"][lo], c["j"][lo], threshold)
                if got is not None:
                    out.append(got)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "n", "root"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            c = columns(b) if held is None else join(held, columns(b))
            new = (c["cell"][1:] != c["cell"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])
            starts = np.concatenate(([0], np.flatnonzero(new) + 1))
            if (got := finished(c, starts)) is not None:
                yield got
            held = rows(c, starts[-1], len(c["id"]))
        if held is not None and (got := finished(held, np.array([0, len(held["id"])]))) is not None:
            yield got
    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label", tables: int = 4, probes: int = 3, scale: float = 0.75, block: int = 1024) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id that links reach, itself included), kept (vec_id = component_id).

    Only vectors of one label and one length are compared. A null label, a vector that is null, empty or
    zero or holds a null or non-finite component, and a null id link with nothing (a null id has no
    component and isn't kept). Equal rows are one vector; an empty table gives no rows; other columns
    are not read. Pairs below the threshold are never linked; those above are found if they share a
    cell, which random directions make likely but not certain (see the README for measured recall)."""
    workers(vectors)
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("l"),
                          F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where("vec_id is not null and l is not null and v is not null and size(v) > 0").where(~bad).where(
        F.exists("v", lambda x: x != 0)).distinct()
    classes = staged(usable.groupBy("l", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    coded = staged(classes.select("id", F.xxhash64("l").alias("h"), "n", "v").mapInArrow(
        _encode(tables, probes, scale), "id long, h long, n long, v array<double>, cells array<long>"), "cells")
    filed = coded.select("id", "n", "v", "cells", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = coded.select(F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").count().where("count > 1")
    sizes = staged(sizes.select("cell", F.ceil(F.col("count") / block).cast("int").alias("k")), "sizes")
    dealt = (filed.join(small_broadcast(sizes, 500_000), "cell")
             .withColumn("g", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("cell", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "id", "n", "v", "cells", "g"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    met = staged(met.mapInArrow(_compare(threshold, tables * (1 + probes)), "id long, n long, root long"), "met")
    counts = met.groupBy("id").agg(F.sum("n").alias("links"))
    comp = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors")
    members = usable.join(classes.select("l", "v", "id", "n"), ["l", "v"])
    known = (members.join(counts, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
             .groupBy(F.col("vec_id").alias("_v")).agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                                                       F.min(F.coalesce("component", "id")).alias("c")))
    out = rows.select("vec_id").join(staged(known, "known"), F.col("vec_id") == F.col("_v"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
     AND list_cosine_similarity(x.e, y.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
t AS (SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id) AS n, least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS c FROM embeddings)
SELECT vec_id, CAST(n AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, vec_id = c AS kept FROM t
"""
