"""Decontamination and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re

import pytest

from taxonspark.llm import decontam, jaccard
from taxonspark.llm.common import components, word_hashes

DOC = "doc_id long, text string, n_hit string, component_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated_by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                owners = windows.get(tuple(w[p:p + n]))
                if owners:
                    hit.update(range(p, p + n))
                    found |= {str(o) for o in owners if o is not None}
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["Éa", "ça", "x9", "Ünder"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 2, 5, 10, 14, 40))))) for i in range(25)]
    items += [(3, items[3][1]), (None, items[4][1] + " extra words of no id"), (90, None), (91, ""), (92, "--- !!")]
    docs = [(0, None), (1, ""), (2, "..."), (None, items[8][1])]
    for i in range(3, 80):
        words = [rng.choice(vocab) for _ in range(rng.choice((1, 4, 30, 200)))]
        for _ in range(rng.choice((0, 1, 3))):
            at = rng.randrange(len(words) + 1)
            words[at:at] = (items[rng.randrange(25)][1]).split()[rng.randrange(3):]
        docs.append((i, rng.choice((" ", ", ", "\n")).join(words).upper() if i % 9 == 0 else " ".join(words)))
    docs += [(5, docs[6][1]), docs[20], docs[20], (500, " ".join(rng.choice(vocab) for _ in range(60_000)))]
    return docs, items


@pytest.mark.parametrize("chunk", [8 << 20, 400])
def test_decontaminate_equals_brute_force(spark, contaminated, chunk):
    docs, items = contaminated
    df = spark.createDataFrame([(d, t, "x", None) for d, t in docs], DOC)
    it = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.digest(decontam.decontaminate(df, it, max_chunk_bytes=chunk))
    assert sorted((tuple(r) for r in got.collect()), key=str) == contaminated_by_hand(docs, items)


def test_decontaminate_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.decontaminate(docs, items.limit(0)).orderBy("doc_id").collect()] == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def groups_by_hand(docs, words=5, threshold=75):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= threshold * (len(sets[i]) + len(sets[j]) - o):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=str)


@pytest.fixture(scope="module")
def near():
    rng = random.Random(11)
    docs = [(900, None), (901, ""), (902, " \t\n"), (903, "a b"), (904, "A  B"), (None, "a b"), (905, "a b c")]
    for family in range(22):
        n = rng.choice((5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 30, 120))
        base = [f"f{family}x{rng.randrange(10_000)}" for _ in range(n)]
        for _ in range(rng.choice((2, 5, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice(([], [f"e{rng.randrange(5)}"], [w[k], "ins"]))
            if rng.random() < 0.2:
                w += [f"tail{rng.randrange(3)}"] * rng.randrange(1, 5)
            docs.append((len(docs), " ".join(w)))
    passage = [f"p{i}" for i in range(40)]  # many share it, few are alike
    for i in range(40):
        docs.append((len(docs), " ".join(passage + [f"q{i}y{k}" for k in range(rng.choice((3, 9, 11, 30)))])))
    docs += [docs[12], docs[12], (5000, docs[30][1])]
    docs.append((6000, " ".join(f"long{i}" for i in range(50_000))))
    docs.append((6001, " ".join(f"long{i}" for i in range(46_000))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("boundary", [None, 1, 4, 9])
def test_jaccard_groups_equal_brute_force(spark, near, boundary):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in near], DOC).repartition(5)
    got = sorted((tuple(r) for r in jaccard.jaccard_groups(df, boundary=boundary).collect()), key=str)
    assert got == groups_by_hand(near)


def test_jaccard_other_thresholds(spark, near):
    small = [d for d in near if d[0] is None or d[0] < 6000]
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    for words, threshold in ((3, 60), (2, 90)):
        got = sorted((tuple(r) for r in jaccard.jaccard_groups(df, words=words, threshold=threshold).collect()), key=str)
        assert got == groups_by_hand(small, words, threshold)


def test_jaccard_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_groups(df).count() == 0


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({}, 0, 75) == 1
    few = jaccard.choose_boundary({n: 10 for n in range(1, 14)}, 1000, 75)
    assert 1 <= few <= jaccard.MAX_BOUNDARY
    # subsets of tiny sets are cheaper than scanning and verifying them
    assert jaccard.choose_boundary({2: 1000, 3: 1000}, 0, 75) >= 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300, 360)] + [(0, i) for i in range(1, 80)] + [(7, 7), (1000, 90), (90, 1000)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: find(x) for x in root}


def test_word_hashes_by_position_and_chunk():
    import numpy as np
    text = np.frombuffer(b" Ab ab\tabc ab", np.uint8)
    h, start, end = word_hashes(text, np.array([0, 12]))  # the break splits the last word
    assert list(start) == [1, 4, 7, 11, 12] and list(end) == [3, 6, 10, 12, 13]
    assert h[0] == h[1] and len({*h.tolist()}) == 4
