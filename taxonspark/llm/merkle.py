"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; the leaves of a group (ordered by id) form one tree of fan-out 8, the groups' roots form
the last. Positions come from a range partitioning, so that no group meets in one task. A task takes one
aligned block of ``8 ** HEIGHT`` positions and appends its leaves one after the other: the witness of
an appended leaf hangs on the open subtree that holds it, and every run of siblings that completes later
adds its step to all the witnesses below. Block roots are appended the same way, in blocks of their own, until one
node is left; then the witnesses go down again, each block taking its root's witness as the upper part of its
leaves' witnesses. A task holds one block and one witness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_broadcast, staged, workers

FAN, HEIGHT, HEX = 8, 3, 64
BLOCK = FAN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
WITNESS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and itself (integers in decimal)."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def folded(digest: Column, witness: Column) -> Column:
    """The root that ``digest`` and a witness give."""
    return F.aggregate(witness, digest, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(witness: Column) -> Column:
    """All siblings of a witness, level by level, left to right, as one string of hex digests."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), "")


class Subtrees:
    """The open subtrees of one aligned block. ``append`` takes the next node and the witnesses below it; a
    run that fills up is closed, which extends the witnesses of all its members and appends its digest one level up."""

    def __init__(self, height: int):
        self.runs: list = [([], []) for _ in range(height)]
        self.root: str | None = None

    def append(self, digest: str, below: list, level: int = 0) -> None:
        if level == len(self.runs):
            self.root = digest
            return
        run, members = self.runs[level]
        run.append(digest)
        members.append(below)
        if len(run) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run, members = self.runs[level]
        self.runs[level] = ([], [])
        joined = "".join(run)
        for k, below in enumerate(members):
            step = (joined[:HEX * k], joined[HEX * (k + 1):])
            for witness in below:
                witness.append(step)
        self.append(hashlib.sha256(joined.encode()).hexdigest(), [w for below in members for w in below], level + 1)

    def finish(self) -> None:
        """The end of the data: what is still open closes with fewer members."""
        for level, (run, _) in enumerate(self.runs):
            if run:
                self.close(level)


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes: as long as several nodes remain."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (tree, block) after the other, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        t, k = b.column("tree").to_numpy(), b.column("block").to_numpy()
        edges = [0, *(np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and key != (t[lo], k[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            key = (t[lo], k[lo])
    if held:
        yield pa.Table.from_batches(held)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow (tree, block, pos, n, digest), sorted -> (tree, pos = block, n = blocks of the tree, digest = root of the block)."""
    for block in _blocks(batches):
        n = block["n"][0].as_py()
        open_ = Subtrees(min(HEIGHT, levels_of(n)))
        for d in block["digest"].to_pylist():
            open_.append(d, [])
        open_.finish()
        yield pa.RecordBatch.from_pydict({"tree": block["tree"][:1].combine_chunks(), "pos": block["block"][:1].combine_chunks(),
                                          "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": [open_.root]})


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over nodes and, at position -1, their block's root: its witness and subroot. Gives the nodes
    with whole witnesses."""
    for block in _blocks(batches):
        upper = [(s["before"], s["after"]) for s in block["witness"][0].as_py()]
        nodes = block.slice(1)
        open_, found = Subtrees(min(HEIGHT, levels_of(nodes["n"][0].as_py()))), []
        for d in nodes["digest"].to_pylist():
            found.append([])
            open_.append(d, [found[-1]])
        open_.finish()
        steps = [s for w in found for s in (*w, *upper)]
        ends = np.cumsum([0, *(len(w) + len(upper) for w in found)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)], fields=list(STEP))
        cols = {c: nodes[c].combine_chunks() for c in ("tree", "pos", "digest", "carried")}
        cols |= {"witness": pa.ListArray.from_arrays(pa.array(ends), values),
                 "subroot": pa.array([block["subroot"][0].as_py()] * nodes.num_rows, pa.string())}
        yield pa.RecordBatch.from_pydict(cols)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[str], tag: str) -> tuple[DataFrame, int]:
    """``rows`` (with a non-null ``tree``), each with its position ``pos`` in its tree by ``order`` and the tree's size
    ``n``, and the largest size: sorted by ranges, so a large tree takes many tasks, whose starts are then summed."""
    ranged = rows.repartitionByRange(_parts(rows), "tree", *order).sortWithinPartitions("tree", *order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = staged(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", at), tag)
    pieces = ranged.groupBy("tree", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_rows"))
    by_tree = Window.partitionBy("tree")  # a row per range that the tree spans
    pieces = pieces.select("tree", "_p", (F.sum("_rows").over(by_tree.orderBy("_p")) - F.col("_rows") - F.col("_first")).alias("_off"),
                           F.sum("_rows").over(by_tree).alias("n"))
    pieces = staged(pieces, f"{tag}-starts")
    largest = pieces.agg(F.max("n")).first()[0] or 0
    return ranged.join(small_broadcast(pieces, 500_000), ["tree", "_p"]).withColumn("pos", F.col("_i") + F.col("_off")).drop("_p", "_i", "_off"), largest


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition(_parts(nodes), "tree", "block").sortWithinPartitions("tree", "block", "pos")


def climb(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Levels of block roots above ``nodes`` (tree, pos, n, digest), up to one node a tree."""
    levels = [nodes]
    while largest > 1:
        at = levels[-1].select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest")
        levels.append(staged(_dealt(at).mapInArrow(_roots, "tree long, pos long, n long, digest string"), "roots"))
        largest = -(-largest // BLOCK)
    return levels


def descend(levels: list[DataFrame], upper: DataFrame) -> DataFrame:
    """(tree, pos, digest, carried, witness, subroot) of the nodes of ``levels[0]``, from those of the one node a tree in
    ``levels[-1]`` (tree, pos, witness, subroot)."""
    if len(levels) == 1:  # every tree is a single node
        one = levels[0].join(small_broadcast(staged(upper.select("tree", "witness", "subroot"), "upper"), 10_000), "tree")
        return one.select("tree", "pos", "digest", "carried", "witness", "subroot")
    for k, nodes in reversed(list(enumerate(levels[:-1]))):
        carried = F.col("carried") if k == 0 else F.lit(None).cast("string")
        kind = nodes.schema["carried"].dataType.simpleString() if k == 0 else "string"
        rows = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest", carried.alias("carried"),
                            F.lit(None).cast(WITNESS).alias("witness"), F.lit(None).cast("string").alias("subroot"))
        tops = upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
                            F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("carried"), "witness", "subroot")
        upper = _dealt(rows.unionByName(tops)).mapInArrow(
            _witnesses, f"tree long, pos long, digest string, carried {kind}, witness {WITNESS}, subroot string")
        if k:
            upper = staged(upper, "witnesses")
    return upper


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the column ``key``, the columns of ``carry`` (computed from ``docs``), leaf, witness (its steps
    from the leaf to the root: the siblings before and after it, as joined hex digests), subroot (of its group) and root.

    Groups are ordered by value (null first, UTF-8 bytewise), rows in a group by ``key`` (null first), rows of one key
    by their leaf; repeated rows are leaves of their own. Nulls in any field have an encoding of their own, texts are
    hashed whole, an empty table gives no rows, and columns that aren't named here are not read. A lone leaf is its
    group's root, and a lone group's root is the root."""
    workers(docs)
    carry = carry or {}
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"),
                       F.struct(F.col(key).alias("key"), *(c.alias(name) for name, c in carry.items())).alias("carried"))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    groups = rows.select("group").distinct().select(F.lit(0).cast("long").alias("tree"), "group")
    groups, count = numbered(groups, ["group"], "groups")
    if not count:
        return rows.select("carried.*", F.col("digest").alias("leaf"), F.lit(None).cast(WITNESS).alias("witness"),
                           F.lit("").alias("subroot"), F.lit("").alias("root")).withColumnRenamed("key", key)
    named = small_broadcast(groups.select(F.col("group").alias("_g"), F.col("pos").alias("tree")), 100_000)
    leaves = rows.join(named, F.col("group").eqNullSafe(F.col("_g"))).select("tree", "key", "digest", "_row", "carried")
    leaves, largest = numbered(leaves, ["key", "digest", "_row"], "leaves")
    levels = climb(leaves.select("tree", "pos", "n", "digest", "carried"), largest)
    tops = staged(levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest",
                                    F.lit(None).cast("string").alias("carried")), "subroots")
    above = climb(tops, count)
    root = above[-1].select("digest").first()[0]
    start = above[-1].select("tree", "pos", F.array().cast(WITNESS).alias("witness"), F.lit(None).cast("string").alias("subroot"))
    upper = descend(above, start).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot"))
    found = descend(levels, staged(upper, "subroot-witnesses"))
    return found.select("carried.*", F.col("digest").alias("leaf"), "witness", "subroot", F.lit(root).alias("root")).withColumnRenamed("key", key)


def verify(docs: DataFrame, *, tampered: Column, change: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The manifest's digests and the outcome of a verification in which the rows of ``tampered`` have ``change`` as text: doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified. A row whose ``tampered`` is null is as it was."""
    now = leaf([change if c == text else F.col(c) for c in FIELDS])
    claim = F.when(tampered, now)
    rows = manifest(docs, key=key, carry={"claim": claim})
    out = rows.select(F.col(key).alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"),
                      folded(F.coalesce("claim", "leaf"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def verify_case_change(docs: DataFrame) -> DataFrame:
    """``verify`` with the texts of every third document (by the CRC-32 of its id) lower-cased in A-Z."""
    upper = "".join(map(chr, range(65, 91)))
    return verify(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, change=F.translate("text", upper, upper.lower()))


def _crc32_sql(s: str) -> str:
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _leaf_sql(text: str) -> str:
    cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cols) + ")"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf, {_leaf_sql(_LOWER_SQL)} AS low,
       coalesce({_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0, false) AS bad FROM documents),
langs AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM documents)),
placed AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN bad THEN low ELSE leaf END AS claim, t,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n
       FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
up(t, lev, pos, h, n) AS (SELECT t, 0, pos, leaf, n FROM placed
       UNION ALL SELECT t, lev + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY t, lev, pos // 8, n),
subs AS MATERIALIZED (SELECT t, lev, h, (SELECT count(*) FROM langs) AS n FROM up WHERE n = 1),
top(lev, pos, h, n) AS (SELECT 0, t, h, n FROM subs
       UNION ALL SELECT lev + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lev, pos // 8, n),
runs AS MATERIALIZED (SELECT t, lev, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY t, lev, pos // 8
       UNION ALL SELECT subs.t, subs.lev + r.lev, r.run, r.hs FROM (SELECT lev, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY lev, pos // 8) r, subs),
fold(doc_id, leaf, t, lev, sublev, pos, f, proof) AS (SELECT doc_id, leaf, placed.t, 0, subs.lev, pos, claim, '' FROM placed JOIN subs ON placed.t = subs.t
       UNION ALL SELECT doc_id, leaf, fold.t, fold.lev + 1, sublev, k // 8,
              sha256(array_to_string([CASE WHEN i = k % 8 + 1 THEN f ELSE x END for x, i in hs], '')), proof || array_to_string([x for x, i in hs if i <> k % 8 + 1], '')
       FROM (SELECT *, CASE WHEN lev = sublev THEN t ELSE pos END AS k FROM fold) fold JOIN runs ON runs.t = fold.t AND runs.lev = fold.lev AND runs.run = k // 8)
SELECT doc_id, leaf, subs.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM fold JOIN subs ON fold.t = subs.t JOIN top ON top.n = 1 WHERE fold.lev = subs.lev + top.lev
"""
