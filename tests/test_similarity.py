import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from taxonspark.functions.similarity import (encode_names, jaro_winkler, jaro_winkler_many, jaro_winkler_pairs, jaro_winkler_udf,
                                             weighted)
from taxonspark.operators import similarity as S
from taxonspark.operators.balls import Balls, upper_bounds
from taxonspark.params import Params


def test_jaro_winkler_reference_cases():
    assert jaro_winkler("", "abc") == 0.0
    assert jaro_winkler("a", "") == 0.0
    assert jaro_winkler("奶茶", "奶茶") == 1.0
    assert 0 < jaro_winkler("奶茶", "奶荼") < 1.0
    assert jaro_winkler("奶茶", "奶荼") == pytest.approx(2 / 3)  # code points, no boost at or below 0.7


def test_weighted(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "c double, j double")
    got = [r["o"] for r in df.select(weighted(F.col("c"), F.col("j"), 0.5).alias("o")).collect()]
    assert got == [1.0, 0.0, 0.5, 0.5]


def test_udf_matches_python(spark):
    pairs = [("奶茶店", "奶茶"), ("  red rod ", "red rod"), ("", "x"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["o"] for r in df.select(jaro_winkler_udf("a", "b").alias("o")).collect()]
    assert got == [jaro_winkler(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 奶茶荼　", max_size=12), st.lists(st.text(alphabet="ab 奶茶荼", max_size=12), min_size=1, max_size=20))
def test_vectorised_equals_scalar(a, names):
    mat, lens = encode_names(names)
    got = jaro_winkler_many(a, mat, lens)
    assert list(got) == [jaro_winkler(a, n) for n in names]


def brute_top1(texts, brands, w, use_combined=True):
    """Plain-Python J5: strict > in brand order, blank names skipped, null vector -> 0."""
    out = {}
    for key, t, tv in texts:
        best, best_b = -1.0, None
        for bidx, name, code, atomic, bv in sorted(brands):
            if not name.strip():
                continue
            c = 0.0 if (tv is None or bv is None) else (float(np.dot(np.asarray(tv, np.float64), np.asarray(bv, np.float64))) + 1) / 2
            s = w * c + (1 - w) * jaro_winkler(t, name) if use_combined else c
            s = min(1.0, max(0.0, s))
            if s > best:
                best, best_b = s, bidx
        out[key] = (best_b, best)
    return out


def make_data(seed, n_text=40, n_brand=60, dim=8):
    rnd = random.Random(seed)
    words = ["red", "blue", "rod", "gear", "奶茶", "ring"]

    def vec():
        v = np.array([rnd.gauss(0, 1) for _ in range(dim)], dtype=np.float32)
        return (v / np.linalg.norm(v)).tolist()
    brands = []
    for i in range(n_brand):
        name = " ".join(rnd.choice(words) for _ in range(2)) if i % 13 else "  "
        brands.append((i * 3, name, str(i), f"a{i % 4}", None if i % 7 == 0 else vec()))
    brands.append((999, brands[5][1], "dup", "a9", brands[5][4]))  # equal score to brand 15: lowest index wins
    texts = [(k, " ".join(rnd.choice(words) for _ in range(2)), None if k % 9 == 0 else vec()) for k in range(n_text)]
    texts.append((n_text, brands[5][1], brands[5][4]))
    return texts, brands


@pytest.mark.parametrize("plan", ["broadcast", "grid"])
@pytest.mark.parametrize("combined", [True, False])
def test_top1_equals_brute_force(spark, plan, combined):
    texts, brands = make_data(7, n_text=150, n_brand=200)
    tdf = spark.createDataFrame(texts, "k long, t string, v array<float>")
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    params = Params(use_combined=combined, brand_block_rows=16, text_block_rows=10)
    got = {r["k"]: (r["brand_idx"], r["score"]) for r in S.top1(tdf, bdf, ["k"], "t", "v", params, plan).collect()}
    want = brute_top1(texts, brands, 0.5, combined)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0], k
        assert got[k][1] == pytest.approx(want[k][1], abs=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_left_out_cannot_hold_the_best(spark, seed):
    """Clustered vectors, names of many lengths, NaN and absent vectors, ties: the pruned grid equals brute force."""
    rnd, rng = random.Random(seed), np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))

    def vec():
        v = centres[rnd.randrange(6)] + 0.2 * rng.standard_normal(12)
        return [float(x) for x in np.float32(v / np.linalg.norm(v))]

    def name():
        return "".join(rnd.choice("abcdé奶茶 ") for _ in range(rnd.randint(1, 9)))

    brands = [(i, name(), str(i), "a", None if i % 11 == 0 else vec()) for i in range(300)]
    brands += [(300 + i, brands[i][1], "tie", "a", brands[i][4]) for i in range(20)] + [(400, "nan", "", "a", [float("nan")] * 12)]
    texts = [(i, name(), None if i % 7 == 0 else vec()) for i in range(80)] + [(90, brands[3][1], brands[3][4]), (91, "a", [float("nan")] * 12)]
    tdf = spark.createDataFrame(texts, "k long, t string, v array<float>")
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    for combined in (True, False):
        params = Params(use_combined=combined, brand_block_rows=15, text_block_rows=10)
        got = {r["k"]: (r["brand_idx"], r["score"]) for r in S.top1(tdf, bdf, ["k"], "t", "v", params, "grid").collect()}
        want = {r["k"]: (r["brand_idx"], r["score"]) for r in S.top1(tdf, bdf, ["k"], "t", "v", params, "broadcast").collect()}
        assert {k: b for k, (b, _) in got.items()} == {k: b for k, (b, _) in want.items()}
        assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want if want[k][1] is not None)


@pytest.mark.parametrize("lengths", [1, 2])
def test_cells_stay_bounded_with_a_number_of_buckets_given(spark, monkeypatch, lengths):
    """A given number of buckets is the least one: more rows make more cells, not larger ones."""
    rows = []
    cells = S._cell_scores
    monkeypatch.setattr(S, "_cell_scores", lambda texts, *x: rows.append(texts.groupBy("_blk", "_tb").count().agg(F.max("count")).first()[0]) or cells(texts, *x))
    tdf = spark.createDataFrame([(i, f"red {i}", [1.0, float(i)]) for i in range(600)], "k long, t string, v array<float>")
    bdf = spark.createDataFrame([(i, f"red {i}", str(i), "a", [1.0, float(i)] + [0.0] * (i % lengths)) for i in range(40)],
                                "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    params = Params(grid_blocks=2, grid_buckets=2, text_block_rows=50)
    assert S.top1(tdf, bdf, ["k"], "t", "v", params, "grid").count() == 600
    assert rows and max(r for r in rows if r) <= 100


def test_texts_without_vectors_meet_blocks_of_names_alike(spark, monkeypatch):
    """Only names count for them, so near vectors must not deal the brands; texts with a vector keep their own blocks."""
    rng = np.random.default_rng(4)
    kinds = ["anvil", "bolt", "gear", "plate", "ring", "widget"]
    vec = lambda: [float(x) for x in np.float32(rng.standard_normal(8))]
    brands = [(i, f"{kinds[i % 6]} {1000 + i}", str(i), "a", vec() if i % 5 else None) for i in range(240)]
    texts = [(i, f"{kinds[i % 6]} {1500 + i}", None) for i in range(60)] + [(100 + i, f"{kinds[i % 6]} {i}", vec()) for i in range(12)]
    tdf = spark.createDataFrame(texts, "k long, t string, v array<float>")
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    met = []
    cells = S._cell_scores
    monkeypatch.setattr(S, "_cell_scores", lambda texts, brands, dim, *x: met.append((dim, texts.count())) or cells(texts, brands, dim, *x))
    params = Params(brand_block_rows=20)
    got, want = ({r["k"]: (r["brand_idx"], r["score"]) for r in S.top1(tdf, bdf, ["k"], "t", "v", params, plan).collect()} for plan in ("grid", "broadcast"))
    assert {k: b for k, (b, _) in got.items()} == {k: b for k, (b, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    assert sum(n for dim, n in met if dim == 0) < 60 * 12 / 3 and sum(n for dim, n in met if dim) >= 12


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab奶 1", max_size=70), st.text(alphabet="ab奶 1", max_size=63)), min_size=1, max_size=12))
def test_pairs_by_bits_equal_scalar(pairs):
    got = jaro_winkler_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert list(got) == [jaro_winkler(a, b) for a, b in pairs]


def test_bounds_hold_and_leave_blocks_out(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    point = lambda: (centres[rng.integers(20)] + 0.03 * rng.standard_normal(16)).tolist()
    brands = [(i, f"brand {i % 50}", str(i), "a", point()) for i in range(1000)]
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<double>")
    params = Params(brand_block_rows=25)
    balls = Balls(bdf.select("brand_idx", "brand_name", "brand_code", "atomic", "embedding"), 16, 1000, params)
    blocks = {r["_blk"]: [] for r in balls.brands.select("_blk").distinct().collect()}
    for r in balls.brands.collect():
        blocks[r["_blk"]].append(r["brand_idx"])
    assert sorted(i for b in blocks.values() for i in b) == list(range(1000)) and len(blocks) >= 20
    s = balls.summary.value
    left = 0
    for _ in range(30):
        t, q = f"brand {rng.integers(50)}", point()
        ub = upper_bounds([t], [q], s, 16, 0.5, True)[0]
        best = {}
        for j, blk in enumerate(s["blk"].tolist()):
            real = [0.5 * (np.dot(q, brands[i][4]) + 1) / 2 + 0.5 * jaro_winkler(t, brands[i][1]) for i in blocks[blk]]
            assert max(real) <= ub[j]
            best[j] = max(real)
        left += sum(u < max(best.values()) for u in ub)
    assert left / 30 / len(blocks) > 0.7


def test_brand_vectors_of_several_lengths_are_errors_on_both_plans(spark):
    texts = [(1, "abc", [1.0, 0.0]), (2, "x", None)]
    brands = [(0, "xyz", "c", "a", [1.0, 0.0]), (1, "abc", "c", "a", [1.0])]
    tdf = spark.createDataFrame(texts, "k long, t string, v array<float>")
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    got = [sorted(map(str, S.top1(tdf, bdf, "k", "t", "v", Params(), plan).collect())) for plan in ("grid", "broadcast")]
    assert got[0] == got[1] and "ValueError" in got[0][0]


def test_threshold_equality_passes(spark):
    texts = [(1, "abc", [1.0, 0.0])]
    brands = [(0, "xyz", "c", "a", [1.0, 0.0])]
    tdf = spark.createDataFrame(texts, "k long, t string, v array<float>")
    bdf = spark.createDataFrame(brands, "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    score = S.top1(tdf, bdf, ["k"], "t", "v").first()["score"]
    at = S.match_by_similarity(tdf, bdf, ["k"], "t", "v", Params(similarity_threshold=score)).first()
    above = S.match_by_similarity(tdf, bdf, ["k"], "t", "v", Params(similarity_threshold=score + 1e-9)).first()
    assert at["brand_idx"] == 0 and above["brand_idx"] is None


def test_no_brands_gives_null(spark):
    tdf = spark.createDataFrame([(1, "abc", None)], "k long, t string, v array<float>")
    bdf = spark.createDataFrame([], "brand_idx long, brand_name string, brand_code string, atomic string, embedding array<float>")
    assert S.top1(tdf, bdf, ["k"], "t", "v").first()["brand_idx"] is None


def test_kernel_error_becomes_error_row():
    import pandas as pd
    block = S._block_from_pandas(pd.DataFrame({"brand_idx": [1, 2], "brand_name": ["a", "b"], "brand_code": ["1", "2"],
                                               "atomic": ["x", "y"], "embedding": [[1.0, 0.0], [0.0, 1.0]]}), 2)
    block["names"] = ["a"]  # corrupt the block: the kernel must not raise
    block["name_mat"] = block["name_mat"][:1]
    pdf = pd.DataFrame({"k": [1], "_kt": ["b"], "_kv": [[0.0, 1.0]], "_ka": [True]})
    out = S._score_frame(pdf, ["k"], block, 2, 0.5, True, 1000)
    assert out["error"].iloc[0] is not None and out["brand_idx"].iloc[0] is None
