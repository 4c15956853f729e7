"""N-gram Jaccard join: size-aware heavy-light set-similarity join of documents.

Two documents link when 100 * |A and B| >= threshold * |A or B| over their sets of 5-word shingles,
that is when they share at least ``need(|A|, |B|)`` of them. Equal sets are one node (their 64-bit
fingerprint) from the start.

* **Light** sets (at most ``boundary`` shingles) are joined by fixed-size subsets: for every partner
  size l a set lists its subsets of exactly ``need(n, l)`` shingles. Sharing one *is* the link
  condition, so this side needs no verification, and one key's members link through its least ones.
* **Heavy** sets are joined by scanning inverted lists of the shingles of their prefix (the first
  n - ceil(threshold * n) + 1 in the order rare to frequent; two linked sets share one there).
  Pairs of fitting sizes that share enough prefix shingles are verified on the whole sets.
* The boundary is the one of least cost (listed subsets + scanned list entries) by the size
  histogram; sets near it go to both sides, so that each pair of sizes is met on one.

Links are wanted as components, so lists aren't expanded into all pairs. In a few rounds every set tries the
likeliest of its neighbours and hubs in its lists that isn't in its component yet, so that groups of
near-copies, however large, grow together; then only pairs in *different* components are listed in full. No pair is lost: one
left out is inside a component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fewer, mix64, shingle_sets, small_broadcast, staged, workers

#: the most frequent shingles that the prefix order knows by their count (a bound on the broadcast)
ORDERED_SHINGLES = 100_000
#: rounds of trying neighbours before the rest of the pairs is listed (work, not results, depends on it)
ROUNDS = 2
#: members of a list that are handed on together
LIST_BLOCK = 2048
#: the largest boundary between light and heavy sets that is tried
MAX_BOUNDARY = 12


def need(a, b, threshold: int):
    """Least number of shared shingles of two linked sets of sizes a and b."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_len(n, threshold: int):
    return n - -(-threshold * n // 100) + 1


def partner_sizes(n: int, threshold: int, limit: int) -> range:
    return range(max(1, -(-threshold * n // 100)), min(limit, 100 * n // threshold) + 1)


def _fingerprint(s: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _repeated(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``x`` holds ``least`` times or more, and how often."""
    x.sort()
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
    n = np.diff(edge)
    often = n >= least
    return x[edge[:-1][often]], n[often]


def _profile(words: int):
    """mapInArrow (doc_id, text) -> kind 0: (doc_id, set size, fingerprint); kind 1: (shingle, documents
    of this batch that have it, null) for shingles frequent in the batch, which order the prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(1), words)]
            k, n = _repeated(np.concatenate(sets) if sets else np.empty(0, np.int64), max(2, b.num_rows // 4000))
            ids = pa.concat_arrays([b.column(0), pa.array(k)])
            size = np.concatenate((np.array([len(s) for s in sets], np.int64), n))
            fp = [_fingerprint(s) if len(s) else None for s in sets] + [None] * len(k)
            kind = np.repeat(np.array([0, 1], np.int32), [len(sets), len(k)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), ids, pa.array(size), pa.array(fp, pa.int64())],
                                             ["kind", "id", "n", "fp"])
    return run


def choose_boundary(sizes: dict[int, int], heavier: int, threshold: int) -> int:
    """The boundary of least cost: subsets listed by light sets against list entries scanned for the
    others; ``sizes`` counts sets of up to ``MAX_BOUNDARY`` + 1 shingles, ``heavier`` all larger ones."""
    def subsets(n: int, x: int) -> int:
        return sum(comb(n, need(n, k, threshold)) for k in partner_sizes(n, threshold, x))

    def cost(x: int) -> int:
        light = sum(c * subsets(n, x) for n, c in sizes.items() if n <= x)
        # a scanned entry is verified too, on the whole sets: charge it for that
        heavy = sum(c * prefix_len(n, threshold) * (1 + n) for n, c in sizes.items() if 100 * n >= threshold * (x + 1))
        return light + heavy
    return min(range(1, MAX_BOUNDARY + 1), key=lambda x: (cost(x), x)) if sizes or heavier else 1


def _keys(words: int, threshold: int, boundary: int, hot):
    """mapInArrow (text) -> (token, fp, n, pos): pos >= 0 is a prefix shingle's place, -1 a subset of a
    set with partners of its own size, -2 one with partners of another size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        keys, rank = hot.value  # sorted frequent shingles and their place in the order
        bits = np.zeros(1 << 22, bool)
        bits[keys & 0x3FFFFF] = True
        for b in batches:
            out: list[list] = [[], [], [], []]

            def put(token, fp, n, pos):
                m = len(token)
                for col, v in zip(out, (token, np.full(m, fp, np.int64), np.full(m, n, np.int32), pos), strict=True):
                    col.append(v)

            for _, s in shingle_sets(b.column(0), words):
                n = len(s)
                if not n or (fp := _fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                if len(seen) > 2_000_000:
                    seen.clear()
                if n <= boundary:
                    for k in partner_sizes(n, threshold, boundary):
                        head = np.array([min(n, k), max(n, k)], np.int64).tobytes()
                        got = [xxhash.xxh64_intdigest(head + np.array(c, np.int64).tobytes())
                               for c in combinations(s.tolist(), need(n, k, threshold))]
                        put(np.array(got, np.uint64).view(np.int64), fp, n, np.full(len(got), -1 if k == n else -2, np.int32))
                if 100 * n >= threshold * (boundary + 1):
                    maybe = np.flatnonzero(bits[s & 0x3FFFFF])
                    if len(maybe):
                        at = np.minimum(np.searchsorted(keys, s[maybe]), len(keys) - 1)
                        known = keys[at] == s[maybe]
                        often = maybe[known][np.argsort(rank[at[known]])]
                        rest = np.ones(n, bool)
                        rest[often] = False
                        s = np.concatenate((s[rest], s[often]))
                    p = prefix_len(n, threshold)
                    put(s[:p], fp, n, np.arange(p, dtype=np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["token", "fp", "n", "pos"])
    return run


def _lists(threshold: int):
    """mapInArrow over a hash partition of keys: drops keys of one set; kind 0 keeps the entries
    (token, fp, n) of prefix shingles with several; kind 2: links (fp, fp) by subsets, each to a least
    member of its key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        token, fp, n, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((fp, n, token))
        token, fp, n, pos = token[order], fp[order], n[order], pos[order]
        first = np.ones(len(token), bool)  # a copy listed by another task
        first[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1]) | (n[1:] != n[:-1])
        token, fp, n, pos = token[first], fp[first], n[first], pos[first]
        same = token[1:] == token[:-1]
        many = np.zeros(len(token), bool)
        many[1:] |= same
        many[:-1] |= same
        token, fp, n, pos = token[many], fp[many], n[many], pos[many]
        if not len(token):
            return
        heavy = pos >= 0

        def rows(kind, a, b, c):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(c)],
                                              ["kind", "token", "fp", "n"])

        yield rows(0, token[heavy], fp[heavy], n[heavy])
        start = np.ones(len(token), bool)
        start[1:] = token[1:] != token[:-1]
        head = np.flatnonzero(start)[np.cumsum(start) - 1]
        light = ~heavy
        # equal sizes: all to the least; other sizes: the larger to the least smaller one, the smaller to a larger one
        end = np.concatenate((np.flatnonzero(start)[1:], [len(token)]))[np.cumsum(start) - 1] - 1
        target = np.where((pos == -1) | (n != n[head]), head, np.where(n[end] != n, end, np.arange(len(token))))
        links = light & (target != np.arange(len(token)))
        yield rows(2, fp[links], fp[target][links], n[links])
    return run


def _neighbours(threshold: int, turn: int):
    """mapInArrow over a hash partition of (token, fp, n, k, c): pairs (a, b, n1, n2) of different components
    so far, by list: every set with the next one, ordered by size and, among equal sizes, by a hash that is
    another one in every ``turn``; and with the hub, the set that stands in most lists (k) and is
    likely closest to what the others were copied from (or with the best one of another component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        token, fp, n, k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        shuffled = mix64(fp.view(np.uint64) + np.uint64(turn))

        def pairs(x, y):
            small = (n[x] < n[y]) | ((n[x] == n[y]) & (fp[x] < fp[y]))
            x, y = np.where(small, x, y), np.where(small, y, x)
            ok = (c[x] != c[y]) & (100 * n[x].astype(np.int64) >= threshold * n[y].astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(v[ok]) for v in (fp[x], fp[y], n[x], n[y])], ["a", "b", "n1", "n2"])

        order = np.lexsort((shuffled, n, token))
        same = token[order][1:] == token[order][:-1]
        yield pairs(order[:-1][same], order[1:][same])
        order = np.lexsort((shuffled, -k, token))
        start = np.ones(len(order), bool)
        start[1:] = token[order][1:] != token[order][:-1]
        place = np.cumsum(start) - 1
        hub = order[start][place]
        for _ in range(2):  # a hub counts twice: it is the likelier link
            yield pairs(order, hub)
        other = c[order] != c[hub]
        second = np.full(place[-1] + 1, -1)
        at = np.flatnonzero(other)[::-1]
        second[place[at]] = order[at]  # the first of its list wins, being written last
        mine = ~other & (second[place] >= 0)
        yield pairs(order[mine], second[place[mine]])
    return run


def _shared_sql(threshold: int) -> str:
    """How many shingles two linked sets share in their prefixes at least: the others lie behind the
    prefix of the one whose prefix ends first."""
    t = threshold
    behind = "ceil({0} * n{1} / 100) - 1"
    return f"ceil({t} * (n1 + n2) / {100 + t}) - greatest({behind.format(t, 1)}, {behind.format(t, 2)})"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(0), words) if len(s)]
            for lo in range(0, len(sets), 500):
                part = sets[lo:lo + 500]
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in part], pa.int64()),
                                                  pa.array(part, pa.list_(pa.int64()))], ["fp", "s"])
    return run


class _Verifier:
    """Verifies candidate pairs by whole sets, which are made once for each document that needs one."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, words: int, threshold: int):
        self.docs, self.nodes, self.words, self.threshold = docs, nodes, words, threshold
        self.sets: DataFrame | None = None

    def prepare(self, pairs: DataFrame) -> DataFrame:
        """The fingerprints in ``pairs`` (a, b), whose sets exist from now on."""
        fps = staged(fewer(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()), "fps")
        new = fps if self.sets is None else fps.join(self.sets.select("fp"), "fp", "left_anti")
        ids = staged(fewer(self.nodes.join(new, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("_i")).select("_i")), "ids")
        if ids.limit(1).count():
            some = self.docs.join(small_broadcast(ids, 500_000), F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
            # rows that repeat an id can give a set twice or one not asked for: both do no harm to the joins
            made = staged(some.select("_t").mapInArrow(_sets(self.words), "fp long, s array<long>"), "sets")
            self.sets = made if self.sets is None else self.sets.unionByName(made)
        return fps

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        fps = self.prepare(pairs)
        if self.sets is None:
            return pairs
        sets = self.sets.join(small_broadcast(fps, 500_000), "fp", "left_semi")
        both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
                .join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
                .withColumn("o", F.size(F.array_intersect("sa", "sb")).cast("long")))
        linked = 100 * F.col("o") >= self.threshold * (F.size("sa") + F.size("sb") - F.col("o"))
        return staged(both.where(linked).select("a", "b"), "links")


def _open_lists(entries: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The entries (token, fp, n, k, c) of lists that span several components (c) so far."""
    if comp is None:
        return entries.withColumn("c", F.col("fp"))
    tagged = staged(entries.join(comp, entries.fp == comp.node, "left").select(
        "token", "fp", "n", "k", F.coalesce("component", "fp").alias("c")), "tagged")
    several = tagged.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    return staged(tagged.join(several, "token", "left_semi"), "open")


def _count_partners(threshold: int):
    """mapInArrow over rows (x, n, fps, ns) sorted by x, the members of one list block each: the pairs (a, b)
    that share enough lists. Counts are merged row by row, so a set holds one count per partner."""
    def done(x, n, fps, ns):
        fp, at, count = np.unique(np.concatenate(fps), return_index=True, return_counts=True)
        size = np.concatenate(ns)[at].astype(np.int64)
        behind = np.maximum(n - prefix_len(n, threshold), size - prefix_len(size, threshold))
        fp = fp[count >= need(n, size, threshold) - behind]
        return np.full(len(fp), x), fp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, ns = None, [], []
        for b in batches:
            x, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = np.concatenate(([0], np.cumsum(b.column(2).value_lengths().to_numpy())))
            f, s = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)])) if len(x) else np.zeros(1, int)
            out = []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if now is not None and now[0] != x[lo]:
                    out.append(done(*now, fps, ns))
                    fps, ns = [], []
                now = (x[lo], int(n[lo]))
                fps.append(f[ends[lo]:ends[hi]])
                ns.append(s[ends[lo]:ends[hi]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done(*now, fps, ns)], ["a", "b"])
    return run


def _cross_pairs(entries: DataFrame, threshold: int, parts: int) -> DataFrame:
    """All pairs (a, b) of sets in different components whose sizes fit and that share enough of the
    lists ``entries``. Lists are cut into blocks of about ``LIST_BLOCK`` members; each set gathers the blocks of its lists
    as arrays of the members after it (by size and fingerprint) and counts them: no row per pair and list."""
    sizes = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("blocks"))
    member = F.struct("fp", "n", "c")
    blocks = (entries.join(sizes, "token").groupBy("token", F.pmod(F.xxhash64("fp", "token"), F.col("blocks")).alias("block"))
              .agg(F.collect_list(member).alias("members")))
    x = entries.select("token", F.col("fp").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc"))
    later = F.filter("members", lambda m: (m["c"] != F.col("xc")) & (100 * F.col("xn") >= threshold * m["n"]) & (
        (m["n"] > F.col("xn")) | ((m["n"] == F.col("xn")) & (m["fp"] > F.col("x")))))
    met = x.join(blocks, "token").select("x", "xn", later.alias("m")).where("size(m) > 0").select(
        "x", "xn", F.col("m.fp").alias("fps"), F.col("m.n").alias("ns"))
    return met.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(_count_partners(threshold), "a long, b long")


def jaccard_groups(docs: DataFrame, *, words: int = 5, threshold: int = 75, doc_id: str = "doc_id",
                   text: str = "text", boundary: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (set size), component_id (smallest doc_id that
    links reach, itself included).

    Null, empty or wordless texts have an empty set and link with nothing; repeated rows are copies;
    rows without id take part and get the smallest id of their component, null if it has none;
    an empty table gives no rows; other columns are not read. Shingles are compared by 64-bit hashes."""
    spark = workers(docs)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t"))
    profile = staged(docs.mapInArrow(_profile(words), "kind int, id long, n long, fp long"), "profile")
    nodes = profile.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "fp")
    hot = (profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "id").limit(ORDERED_SHINGLES).toArrow())
    keys = hot["id"].to_numpy()[np.lexsort((hot["id"].to_numpy(), hot["n"].to_numpy()))]  # by count
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], order))
    del hot
    if boundary is None:
        small = nodes.where(F.col("n_shingles") > 0).groupBy(F.least("n_shingles", F.lit(MAX_BOUNDARY + 5)).alias("n")).count().collect()
        sizes = {r.n: r["count"] for r in small}
        heavier = sizes.pop(MAX_BOUNDARY + 5, 0)
        boundary = choose_boundary(sizes, heavier, threshold)

    index = docs.select("_t").mapInArrow(_keys(words, threshold, boundary, shared), "token long, fp long, n int, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = staged(index.repartition(2 * parts, "token").mapInArrow(_lists(threshold), "kind int, token long, fp long, n int"), "lists")
    left = lists.where("kind = 0").select("token", "fp", "n")
    left = staged(left.join(left.groupBy("fp").agg(F.count(F.lit(1)).alias("k")), "fp").select("token", "fp", "n", "k"), "entries")
    links = lists.where("kind = 2").select(F.col("token").alias("a"), F.col("fp").alias("b"))
    verifier, comp = _Verifier(docs, nodes, words, threshold), None
    for turn in range(ROUNDS):
        # every set tries the candidate with which it shares most of the open lists
        left = _open_lists(left, comp)
        near = left.repartition(parts, "token").mapInArrow(_neighbours(threshold, turn), "a long, b long, n1 int, n2 int")
        near = near.groupBy("a", "b", "n1", "n2").count().where(f"2 * count >= {_shared_sql(threshold)}")  # not all shared lists make neighbours
        ends = staged(fewer(near.select("a", "b", "count")), "near")
        ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "count"))
        best = ends.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
        best = staged(fewer(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "best")
        new = verifier.links(best)
        left = left.drop("c")
        if comp is not None and not new.limit(1).count():
            break
        links = (links if comp is None else comp.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(new)
        comp = components(links, "round")
    rest = _cross_pairs(_open_lists(left, comp), threshold, parts)
    more = verifier.links(staged(rest, "rest"))
    if more.limit(1).count():
        stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = components(stars.unionByName(more), "all")

    full = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "fp").alias("_c"))
    least = full.where("_c is not null").groupBy(F.col("_c").alias("_k")).agg(F.min("doc_id").alias("component_id"))
    return full.join(least, F.col("_c") == F.col("_k"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: All shared shingles counted per pair, links closed by a recursive query.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b
      WHERE 100 * o >= 75 * (za.n + zb.n - o)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles,
       CAST(least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN z USING (doc_id)
"""
