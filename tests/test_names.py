"""Best names by groups and cells against plain Jaro-Winkler, and how much of the names is looked at."""

import random

import numpy as np
import pytest

from taxonspark.functions import names as N
from taxonspark.functions.similarity import encode_names, jaro_winkler, jaro_winkler_many


def _expected(text, names, cos, w):
    jw = np.array([jaro_winkler(text, n) for n in names])
    s = np.clip((0.0 if cos is None else w * cos) + (1 - w) * jw, 0.0, 1.0)
    s = np.where(np.isnan(s), -np.inf, s)
    j = int(s.argmax())
    return (j, s[j]) if np.isfinite(s[j]) else (-1, None)


def test_best_name_equals_brute_force():
    rng, np_rng = random.Random(1), np.random.default_rng(2)
    for trial in range(120):
        letters = "abcd é " if trial % 2 else "abcdefgh 0123456789"
        names = ["".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 8, 14])))).strip() or "a"
                 for _ in range(rng.choice([1, 5, 60, 300]))]
        index = N.NameIndex(names)
        # short texts, texts whose windows matter, long ones; some twice, as a kind of text is kept when it comes again
        texts = ["".join(rng.choice(letters + "zq") for _ in range(rng.choice([1, 8, 15, 30, 40, 70, 200, 500]))) for _ in range(10)]
        texts = [*texts, *texts[:5], names[0], " "]
        cos = np_rng.choice([0, .25, .5, 1, np.nan], size=(len(texts), len(names))) if trial % 4 == 1 else None
        got = index.best(texts, None if cos is None else cos[:, index.rank], 0.5)
        for i, text in enumerate(texts):
            p, s = got[i]
            want = _expected(text, names, None if cos is None else cos[i], 0.5)
            assert (int(index.rank[p]) if p >= 0 else -1) == want[0], text
            assert p < 0 or s == want[1]


def test_few_names_are_compared(monkeypatch):
    """A short text meets the names whose bound reaches its best, a long one no name by itself."""
    names = [f"{a} {b} {2 * k + 1}" for k in range(400) for a in ("blue", "large", "hot") for b in ("anvil", "ring", "widget")]
    index = N.NameIndex(names)
    compared = []
    rows = N._jaro_winkler_rows
    monkeypatch.setattr(N, "_jaro_winkler_rows", lambda a, la, b, lb: compared.append(len(b)) or rows(a, la, b, lb))
    looked = []
    bounds = N.NameIndex._bounds
    monkeypatch.setattr(N.NameIndex, "_bounds", lambda self, *x: looked.append(len((got := bounds(self, *x))[0])) or got)
    index.best(["large widget 700"], None, 0.5)
    assert sum(compared) < len(names) / 4 and sum(looked) < len(names)
    long = "the old blue ring and a large hot anvil of widgets went by " * 20
    index.best([long, long], None, 0.5)
    compared.clear()
    built = []
    monkeypatch.setattr(N.NameIndex, "_matched", lambda *x: built.append(1))
    assert index.best([long + "s"], None, 0.5)[0][0] >= 0
    assert not compared and not built


def test_names_below_a_score_known_elsewhere_are_not_looked_at(monkeypatch):
    names = [f"{a} {b} {2 * k + 1}" for k in range(400) for a in ("blue", "large", "hot") for b in ("anvil", "ring", "widget")]
    index = N.NameIndex(names)
    texts = ["large widget 700", "hot ring 1", "none like it"]
    free = index.best(texts, None, 0.5)
    scores = [s for _, s in free]
    assert index.best(texts, None, 0.5, floor=scores) == free  # an equal score is found, as its name may come first
    assert index.best(texts, None, 0.5, floor=[float("nan")] * 3) == free
    looked = []
    bounds = N.NameIndex._bounds
    monkeypatch.setattr(N.NameIndex, "_bounds", lambda self, *x: looked.append(len((got := bounds(self, *x))[0])) or got)
    assert [p for p, _ in index.best(texts, None, 0.5, floor=[0.6, 0.6, 0.6])] == [-1, -1, -1]
    assert not sum(looked)


def test_texts_are_bounded_together(monkeypatch):
    """The numpy steps of a batch of texts don't grow with its rows."""
    names = [f"{a} {b} {2 * k + 1}" for k in range(400) for a in ("blue", "large", "hot") for b in ("anvil", "ring", "widget")]
    index = N.NameIndex(names)
    calls = []
    bounds = N.NameIndex._bounds
    monkeypatch.setattr(N.NameIndex, "_bounds", lambda self, *x: calls.append(1) or bounds(self, *x))
    texts = [f"large widget {k}" for k in range(200)]
    got = index.best(texts, None, 0.5)
    assert len(calls) < 20
    for text, (p, s) in list(zip(texts, got, strict=True))[::40]:
        want = _expected(text, names, None, 0.5)
        assert (int(index.rank[p]), s) == want


def test_many_kinds_of_characters_share_bits():
    rng = random.Random(5)
    names = ["".join(chr(0x4E00 + rng.randrange(900)) for _ in range(rng.randint(1, 6))) for _ in range(700)]
    index = N.NameIndex(names)
    assert len(index.kinds) > 64 * len(index.bits)
    texts = [n[:-1] + chr(0x4E00 + rng.randrange(900)) for n in names[::9]]
    for text, (p, s) in zip(texts, index.best(texts, None, 0.5), strict=True):
        want = _expected(text, names, None, 0.5)
        assert (int(index.rank[p]), s) == want, text


def test_float32_products_bound_the_cosines():
    rng = np.random.default_rng(3)
    names = [f"{'ab'[k % 2]}{k}" for k in range(500)]
    index = N.NameIndex(names)
    mat = rng.standard_normal((500, 24)).astype(np.float32) * 30
    q = rng.standard_normal((40, 24)).astype(np.float32).astype(np.float64) * 30
    has, mhas = np.arange(40) % 5 > 0, np.arange(500) % 7 > 0
    mat[~mhas], q[~has] = 0, 0
    longest = float(np.sqrt((mat.astype(float) ** 2).sum(axis=1)).max())
    assert N.Dots.fits(q, longest) and not N.Dots.fits(q * np.nan, longest) and not N.Dots.fits(q * 1e9, longest)
    dots = N.Dots(q, has, mat, mhas, longest)
    exact = np.where(has[:, None] & mhas[None, :], (q @ mat.T.astype(float) + 1) / 2, 0.0)
    text, rows = (x.reshape(-1) for x in np.indices(exact.shape))
    assert np.allclose(dots.exact(text, rows).reshape(exact.shape), exact, rtol=1e-12, atol=1e-9)
    assert (dots.at(text, rows).reshape(exact.shape) >= np.where(mhas[None, :], exact, 0) - 1e-12).all()
    assert (dots.groups(index.starts) >= np.maximum.reduceat(exact, index.starts, axis=1) - 1e-12).all()
    texts = [f"a{k}" for k in range(40)]
    for i, (p, s) in enumerate(index.best(texts, dots, 0.5)):
        all_scores = np.clip(0.5 * exact[i] + 0.5 * np.array([jaro_winkler(texts[i], names[r]) for r in index.rank]), 0, 1)
        assert abs(s - all_scores.max()) < 1e-9 and abs(all_scores[p] - s) < 1e-9


def _work(monkeypatch, n, dots=False):
    """(bounds made, texts with products of all names) for 40 texts among ``n`` names."""
    made, products = [0], [0]
    upper, all_products = N._upper, N.Dots._products

    def counted(m, *a):
        made[0] += m.size
        return upper(m, *a)

    def counted_products(self):
        products[0] += len(self.q)
        return all_products(self)

    monkeypatch.setattr(N, "_upper", counted)
    monkeypatch.setattr(N.Dots, "_products", counted_products)
    rnd, rng = random.Random(3), np.random.default_rng(3)
    words = ["red", "blue", "large", "rod", "gear", "widget", "plate", "hinge"]
    names = [f"{rnd.choice(words)} {rnd.choice(words)} {rnd.randrange(10 ** 6)}" for _ in range(n)]
    index = N.NameIndex(names)
    if not dots:
        texts = [f"{rnd.choice(words)} {rnd.choice(words)} {rnd.randrange(10 ** 6)}" for _ in range(40)]
        got = index.best(texts, None, 0.5)
        for text, (p, s) in list(zip(texts, got))[:5]:
            jw = 0.5 * jaro_winkler_many(text, *encode_names(names))
            assert s == pytest.approx(jw.max(), abs=1e-12) and index.rank[p] == int(jw.argmax())
    else:
        mat = rng.standard_normal((n, 16)).astype(np.float32)
        mat /= np.linalg.norm(mat, axis=1, keepdims=True)
        own = np.arange(0, n, n // 40)[:40]
        place = np.argsort(index.rank)
        q = mat[place[own]].astype(float)
        has = np.ones(40, bool)
        got = index.best([names[i] for i in own], N.Dots(q, has, mat, np.ones(n, bool), float(np.linalg.norm(mat, axis=1).max())), 0.5, has)
        for k, (p, s) in list(enumerate(got))[:5]:
            jw = jaro_winkler_many(names[own[k]], *encode_names([names[i] for i in index.rank]))
            want = np.clip(0.5 * (mat.astype(float) @ q[k] + 1) / 2 + 0.5 * jw, 0, 1)
            assert s == pytest.approx(want.max(), abs=1e-12) and want[p] == pytest.approx(want.max(), abs=1e-12)
    return made[0], products[0]


def test_bounds_grow_slower_than_the_names(monkeypatch):
    few, many = _work(monkeypatch, 4000)[0], _work(monkeypatch, 32000)[0]
    assert many < 4 * few  # all groups bounded for every text: 8 times


def test_a_text_with_a_name_and_vector_of_its_own_needs_no_product_with_all(monkeypatch):
    assert _work(monkeypatch, 32000, dots=True)[1] < 20  # all texts: 40


@pytest.mark.parametrize("seed", range(4))
def test_runs_left_out_cannot_hold_the_best(seed):
    """Few characters, equal names, absent vectors, floors: the best name and its rank equal brute force."""
    rnd, rng = random.Random(seed), np.random.default_rng(seed)
    names = ["".join(rnd.choice("ab c奶1") for _ in range(rnd.randint(1, 12))).strip() or "a" for _ in range(3000)]
    names += names[:200]
    texts = ["".join(rnd.choice("ab c奶1") for _ in range(rnd.randint(1, 12))).strip() or "b" for _ in range(60)] + names[:20]
    index = N.NameIndex(names)
    mat = rng.standard_normal((len(names), 6)).astype(np.float32)
    mhas, has = rng.random(len(names)) < 0.9, rng.random(len(texts)) < 0.8
    q = rng.standard_normal((len(texts), 6)) * has[:, None]
    q[60:70], has[60:70] = mat[np.argsort(index.rank)[:10]] * 3, True
    mat[~mhas] = 0
    cos = (q @ mat.T.astype(float) + 1) / 2
    cos[~has] = 0
    cos[:, ~mhas] = 0
    jw = np.stack([jaro_winkler_many(t, *encode_names([names[i] for i in index.rank])) for t in texts])
    for dots in (None, N.Dots(q, has, mat, mhas, float(np.sqrt((mat.astype(float) ** 2).sum(axis=1)).max()))):
        want = np.clip(0.5 * (0 if dots is None else cos) + 0.5 * jw, 0, 1)
        top = want.max(axis=1)
        for floor in (None, np.where(np.arange(len(texts)) % 3 == 0, np.nan, top)):
            for k, (p, s) in enumerate(index.best(texts, dots, 0.5, has, floor)):
                if floor is None or np.isnan(floor[k]) or p >= 0:
                    assert s == pytest.approx(top[k], abs=1e-12)
                    assert want[k, p] >= top[k] - 1e-12
                    if dots is None:
                        assert index.rank[p] == index.rank[np.flatnonzero(want[k] == top[k])].min()


def test_long_texts_meet_one_of_the_names_they_cannot_tell_apart(monkeypatch):
    """Names that differ in characters a text lacks are compared once; of many others only those that can be the best."""
    rng = random.Random(5)
    monkeypatch.setattr(N, "ROWS", 512)
    names = [f"{rng.choice(('blue', 'large', 'hot'))} {rng.choice(('anvil', 'ring', 'bolt'))} {7 * k + 1}" for k in range(N.MANY + 100)]
    index = N.NameIndex(names)
    words = ["the", "ring", "went", "by", "a", "lot", "of", "hue", "anvil", "blue", "large", "hut"]
    plain = [" ".join(rng.choice(words) for _ in range(n)) for n in (12, 40, 41, 200, 201)]
    numbered = [f"{p} {n}" for p, n in zip(plain, (7, 1234567890, 98, 2040, 1357911), strict=True)]
    compared = []
    jw = N._jw
    monkeypatch.setattr(N, "_jw", lambda m, t, la, lens, prefix: compared.append(0 if isinstance(t, int) else len(lens)) or jw(m, t, la, lens, prefix))
    got = index.best(plain, None, 0.5)
    assert sum(compared) < len(names)  # five texts
    got += index.best([*numbered, plain[0][:9]], None, 0.5)
    for text, (p, s) in zip([*plain, *numbered, plain[0][:9]], got, strict=True):
        want = _expected(text, names, None, 0.5)
        assert (int(index.rank[p]), s) == want, text
    # vectors tell them apart
    cos = np.random.default_rng(3).random((2, len(names)))
    got = index.best([plain[3], numbered[3]], cos[:, index.rank], 0.5)
    assert [(int(index.rank[p]), s) for p, s in got] == [_expected(t, names, c, 0.5) for t, c in zip((plain[3], numbered[3]), cos, strict=True)]


def test_copied_names_keep_their_rank():
    names = ["hot ring 1", "hot ring 22", "hot ring 1", "old rod"] * 600
    index = N.NameIndex(names)
    got = index.best(["a thing was going hot and the rind fell on the floor of it " * 3] * 2, None, 0.5)
    want = _expected(("a thing was going hot and the rind fell on the floor of it " * 3).strip(), names, None, 0.5)
    assert [(int(index.rank[p]), s) for p, s in got] == [want, want]
