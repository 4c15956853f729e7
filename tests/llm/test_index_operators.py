"""Cuckoo-filter dedup, BOND hard negatives and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxonspark.llm import bond, cuckoo, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ cuckoo

def brute_groups(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
            last = i == keep and not kept
            kept |= last
            out.append((i, keep, len(ids), last, sha(text)))
    return sorted(out, key=repr)


def odd_texts(n=400):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "a", "b\u0000", "B", " b", "Straße 1", "x" * 70000, f"t{rng.randrange(90)}"])) for i in range(n)]
    return [*rows, (None, "a"), (None, "only null"), (None, "only null"), (7, "same"), (7, "same"), (-3, "a")]


@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.sha2(F.substring(t, 1, 1), 256))])
def test_exact_duplicates(spark, digest):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("row", F.lit("x")).withColumn("kept", F.lit(0))
    out = cuckoo.exact_duplicates(df, least_shards=3, **({"digest": digest} if digest else {}))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    if digest is None:
        assert got == brute_groups(rows)
    else:  # many texts of one digest: the contents decide
        assert [r[:4] for r in got] == sorted((r[:4] for r in brute_groups(rows)), key=repr)
    empty = cuckoo.exact_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_live_index(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    first, second = [(i, f"t{i % 30}") for i in range(60)], [(100 + i, f"t{i % 50}") for i in range(50)]
    index = cuckoo.DigestIndex(spark, least_shards=2)
    assert index.insert(frame(first)).count() == 30
    assert index.insert(frame(second)).count() == 30  # those of the first batch; the other twenty are new
    gone = [(i,) for i in range(60) if i % 30 < 10] + [(100 + i,) for i in range(5)] + [(149,), (None,), (12345,)]
    dead = {bytes(r.digest) for r in index.delete(frame([(i, None) for i, in gone])).collect()}
    assert dead == {hashlib.sha256(f"t{i}".encode()).digest() for i in [*range(5), 49]}
    assert index.insert(frame([(200, "t3"), (201, "t3"), (202, "t49"), (203, "t7")])).count() == 2  # t3 twice, t7 is live
    ids = {i for i, in gone}
    live = [r for r in [*first, *second] if r[0] not in ids] + [(200, "t3"), (201, "t3"), (202, "t49"), (203, "t7")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in index.groups().collect()), key=repr)
    assert got == brute_groups(live)


def test_filter_grows_and_forgets():
    f, rng = cuckoo.CuckooFilter(2), random.Random(1)
    keys = [rng.randbytes(32) for _ in range(5000)]
    assert all(f.insert(k) for k in keys) and not any(f.insert(k) for k in keys)
    assert f.mask + 1 >= 5000 / cuckoo.SLOTS and f.n == 5000
    assert all(f.delete(k) for k in keys[:2500]) and not f.delete(keys[0])
    again = cuckoo.CuckooFilter.load(*f.dump())
    assert all(again.slot(k) < 0 for k in keys[:2500]) and all(again.slot(k) >= 0 for k in keys[2500:]) and again.n == 2500


def test_filter_keeps_equal_fingerprints_apart():
    f = cuckoo.CuckooFilter(4)
    a = [b"\x07\x00" + bytes(6) + bytes(8) + bytes([i]) * 16 for i in range(7)]  # one fingerprint, the same two buckets
    assert all(f.insert(k) for k in a) and f.delete(a[3]) and not f.delete(a[3])
    assert [f.slot(k) >= 0 for k in a] == [True, True, True, False, True, True, True]


# ------------------------------------------------------------------ BOND

def brute_negatives(rows, anchor=lambda i: i % 50 == 0, positives=5, negatives=3):
    seen = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in seen:
        if not anchor(a[0]):
            continue
        scored = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in seen if r is not a and len(r[2]) == len(a[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for ps, p in [s for s in scored if s[1][1] == a[1]][:positives]:
            fit = [s for s in scored if s[1][1] != a[1] and 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            out += [(a[0], p[0], k, n[0], ps, ns) for k, (ns, n) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk", [(2048, 1024), (40, 2)])
def test_hard_negatives(spark, block, chunk):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 20))
    rows = []
    for i in range(600):
        v = centres[rng.integers(12)] + 0.4 * rng.standard_normal(20)
        rows.append((i, int(rng.integers(10)), [float(x) for x in np.float32(np.round(v / np.linalg.norm(v), 1 if i % 3 else 3))]))
    rows += [(1000, 1, [0.5] * 20), (1050, 1, None), (1100, None, [0.1] * 20), (1150, 2, [float("nan")] + [0.0] * 19), (1200, 3, [None] * 20), (None, 1, [0.2] * 20),
             (1250, 4, [float("inf")] * 20), (1300, 5, [1.0, 2.0]), (1301, 5, [1.0, 2.0]), (1302, 6, [0.9, 1.5]), (1350, 7, []), (1351, 7, []), (1352, 8, []),
             (1400, 1, [0.0] * 20), (0, *rows[0][1:]), (0, *rows[0][1:]), (-50, 3, [-0.4] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("x")).withColumn("score", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = bond.hard_negatives(df, anchors=F.col("vec_id") % 50 == 0, label=label, block=block, chunk=chunk)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute_negatives(rows) and len(got) > 100
    assert bond.mine(df.limit(0)).count() == 0


def test_scan_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.standard_normal((500, 48)) * np.linspace(2, 0.05, 48))
    left = []

    def keep(live, low, high, more):
        exact = v[live] @ v[0]
        assert (low <= exact).all() and (exact <= high).all()
        left.append(len(live))
        return bond.best_of(5)(live, low, high, more)

    live, score = bond.scan(v[0], np.ascontiguousarray(v.T), v.min(axis=0), v.max(axis=0), np.arange(500) > 0, keep)
    want = np.sort(v[1:] @ v[0])[::-1][:5]
    assert (np.sort(score)[::-1][:5] == want).all() and left[-1] < left[0] / 4


def test_large_components_are_exact(spark):
    big = 2.0 ** 22
    rows = [(0, 1, [big, 1.0, 3.0]), (1, 1, [big, 2.0, 1.0]), (2, 2, [big * 0.9, 1.0, 5.0]), (3, 2, [big * 0.9, 1.0, 5.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in bond.hard_negatives(df, anchors=F.col("vec_id") == 0).collect())
    v = [[math.floor(256 * x) for x in r[2]] for r in rows]
    assert [(r[3], r[5]) for r in got] == [(i, sum(x * y for x, y in zip(v[0], v[i]))) for i in (3, 2)]


# ------------------------------------------------------------------ Merkle

def brute_manifest(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return sha("".join(enc(v) for v in r))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            n = levels[-1]
            levels.append([sha("".join(n[i:i + 8])) for i in range(0, len(n), 8)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [climb([leaf(r) for r in groups[g]]) for g in order]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            low = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f, proof = leaf((*r[:4], low)) if bad else leaf(r), []
            for pos, levels in ((i, trees[k]), (k, top)):
                for level in levels[:-1]:
                    at = pos // 8 * 8
                    run = level[at:at + 8]
                    proof += [h for j, h in enumerate(run) if j != pos - at]
                    run[pos - at] = f
                    f, pos = sha("".join(run)), pos // 8
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], sha("".join(proof)), f, f == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(sizes, seed=2):
    rng, rows, i = random.Random(seed), [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, rng.choice(["s", None, "ü"]), lang, rng.choice([None, 0, 12]), rng.choice(["Ab c", "ab", "", None, "ÄÖ X" * 5, f"T{i}"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, "de": 1}, {"en": 1300, None: 513, "": 8, "é": 65, "z": 512},
                                   {f"l{i}": 1 + i % 3 for i in range(600)}])
def test_manifest(spark, sizes):
    rows = manifest_rows(sizes)
    rows += [(None, None, next(iter(sizes)), None, None), (None, "s", next(iter(sizes)), 1, "A"), rows[0], rows[0], (rows[0][0], "other", *rows[0][2:])]
    df = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("digest", F.lit("x"))
    out = merkle.verify_case_change(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_manifest(rows)
    assert merkle.verify_case_change(df.limit(0)).count() == 0


def test_witnesses_fold_to_the_root(spark):
    rows = manifest_rows({"en": 700, "fr": 30})
    out = merkle.manifest(spark.createDataFrame(rows, DOCS))
    out = out.select("*", merkle.folded(F.col("leaf"), F.col("witness")).alias("f"), merkle.folded(F.sha2(F.lit("no"), 256), F.col("witness")).alias("g"))
    assert out.where("f = root").count() == 730 and out.where("g = root").count() == 0


def test_open_subtrees_extend_their_witnesses():
    tree, seen = merkle.Subtrees(3), []
    digests = [sha(str(i)) for i in range(100)]
    for i, d in enumerate(digests):
        seen.append([])
        tree.append(d, [seen[-1]])
        assert len(seen[i // 64 * 64]) == (2 if i % 64 == 63 else int(i % 64 >= 7))  # a step per subtree that is complete
    tree.finish()
    for d, witness in zip(digests, seen):
        for before, after in witness:
            d = sha(before + d + after)
        assert d == tree.root and len(witness) == 3
