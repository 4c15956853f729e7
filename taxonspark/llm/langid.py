"""Language identification: hierarchical, with linear support vector machines.

A text's features are its letter n-grams (1 to 3 bytes of the lower-cased UTF-8, words framed by
spaces) hashed to ``DIM`` counts, taken as square roots of shares, so every text is a unit vector
whatever its length. Prediction goes down a two-level tree: one-versus-one machines vote for the
language family, then those of the languages inside it.

The machines learn from a bounded, hashed sample of labelled rows (``per_language`` distinct texts of each
language at most; no language is left out); each machine is one group of ``applyInPandas``. Prediction runs over the
whole text of all rows, batch by batch, with the bounded model broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, staged, workers

DIM = 1 << 14
#: ISO 639-1 codes by family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes}
#: more languages than this outside the listed families are put into families of ``GROUP``, by code
MANY, GROUP = 48, 16
#: ASCII letters lowered, UTF-8 continuation and lead bytes kept, all else made spaces
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower(), f"={lang}")


def _hashed(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(18)


def counts(text: bytes) -> np.ndarray:
    """n-gram counts of one text; all zero without letters."""
    b = np.frombuffer(b" " + b" ".join(text.translate(_TABLE).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(DIM)
    two = b[:-1] << np.uint32(8) | b[1:]
    out = np.bincount(_hashed(b + np.uint32(7)), minlength=DIM)
    out += np.bincount(_hashed(two + np.uint32(1 << 16)), minlength=DIM)
    out += np.bincount(_hashed((two[:-1] << np.uint32(8) | b[2:]) + np.uint32(1 << 25)), minlength=DIM)
    return out


def features(text: bytes) -> np.ndarray:
    c = counts(text)
    return np.sqrt(c / max(1, c.sum()))


def sample_rows(labelled: DataFrame, per_language: int) -> DataFrame:
    """(lang, _t): of every language the ``per_language`` distinct texts of the smallest hashes, at most.

    Copies count once, and before the ranking only texts under a share of hashes (three times what is needed, in
    expectation) are kept where a language has many, so no window holds a language as a whole."""
    hashed = F.xxhash64(F.lit(17), "_t")
    texts = labelled.select("lang", hashed.alias("_h"), F.xxhash64("_t", F.lit(29)).alias("_g"), "_t")
    kinds = texts.groupBy("lang", "_h", "_g").count().drop("count")
    kinds = staged(kinds, "kinds")
    sizes = kinds.groupBy("lang").agg(F.least(F.lit(1.0), 3 * per_language / F.count(F.lit(1))).alias("share"))
    low = (F.pmod(F.col("_h"), F.lit(1 << 30)) / F.lit(1 << 30)) < F.col("share")
    near = kinds.join(sizes.withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l")).where(low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("_h"), F.lit(1 << 30)), "_h", "_g"))
    picked = staged(near.select("lang", "_h", "_g", rank.alias("_k")).where(F.col("_k") <= per_language).drop("_k"), "picked")
    rows = texts.join(picked, ["lang", "_h", "_g"], "left_semi")
    return rows.groupBy("lang", "_h", "_g").agg(F.min("_t").alias("_t")).select("lang", "_t")


def _examples(machines: list[tuple[str, tuple, tuple]]):
    """mapInArrow (lang, text) -> (machine, y, text parts): the whole text and two short runs of its
    words, as training must see short texts too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or b"").translate(_TABLE).split()
                if not words:
                    continue
                h = int(mix64(np.array([len(t)], np.uint64))[0])
                cut = [(h + 7 * k) % len(words) for k in range(2)]
                texts = [t, b" ".join(words[cut[0]:cut[0] + 2]), b" ".join(words[cut[1]:cut[1] + 8])]
                for name, pos, neg in machines:
                    if lang in pos or lang in neg:
                        for x in texts:
                            f = features(x)
                            at = np.flatnonzero(f)
                            rows.append((name, 1 if lang in pos else -1, at.astype(np.int32), f[at]))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32())),
                 pa.array(cols[3], pa.list_(pa.float64()))], ["machine", "y", "at", "x"])
    return run


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One linear SVM (squared hinge, classes weighted equally) by dual coordinate descent."""
    pdf = pdf.assign(k=pdf["at"].map(len)).sort_values(["y", "k"], kind="stable")
    y = pdf["y"].to_numpy(np.float64)
    ats, xs = [np.asarray(a) for a in pdf["at"]], [np.asarray(x) for x in pdf["x"]]
    n, w, bias = len(y), np.zeros(DIM), 0.0
    cost = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * 10.0
    alpha, diag = np.zeros(n), 0.5 / cost
    norm = np.array([x @ x for x in xs]) + 1.0 + diag
    rng = np.random.default_rng(7)
    for _ in range(12):
        for i in rng.permutation(n):
            g = y[i] * (w[ats[i]] @ xs[i] + bias) - 1.0 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ats[i]] += step * xs[i]
                bias += step
                alpha[i] = new
    return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "w": [w], "bias": [bias]})


class Model:
    """Families, their languages, and the machines of both levels."""

    def __init__(self, langs: list[str]):
        self.tree: dict[str, list[str]] = {}
        alone = [x for x in sorted(langs) if family(x) == f"={x}"]
        # very many languages of no listed family: in groups, so that machines don't grow with the square
        many = {x: f"+{i // GROUP}" for i, x in enumerate(alone)} if len(alone) > MANY else {}
        for x in sorted(langs):
            self.tree.setdefault(many.get(x) or family(x), []).append(x)
        groups = [sorted(self.tree)] + [v for _, v in sorted(self.tree.items())]
        self.machines = []  # name, positive languages, negative languages
        for level, names in enumerate(groups):
            of = (lambda f: tuple(self.tree[f])) if level == 0 else (lambda x: (x,))
            self.machines += [(f"{level}:{a}|{b}", of(a), of(b)) for a, b in combinations(names, 2)]
        self.names = {m[0]: i for i, m in enumerate(self.machines)}
        self.w = np.zeros((len(self.machines), DIM))
        self.bias = np.zeros(len(self.machines))

    def vote(self, level: int, names: list[str], margin: np.ndarray) -> tuple[str, float]:
        """The name of most one-versus-one wins (margins break ties) and its mean share against the others."""
        if len(names) == 1:
            return names[0], 1.0
        p = {x: 0.0 for x in names}
        wins = {x: 0 for x in names}
        for a, b in combinations(names, 2):
            m = margin[self.names[f"{level}:{a}|{b}"]]
            q = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
            p[a] += q
            p[b] += 1 - q
            wins[a if m >= 0 else b] += 1
        best = max(names, key=lambda x: (wins[x], p[x], x))
        return best, p[best] / (len(names) - 1)

    def predict(self, f: np.ndarray) -> tuple[str, float]:
        margin = self.w @ f + self.bias
        fam, p = self.vote(0, sorted(self.tree), margin)
        level = 1 + sorted(self.tree).index(fam)
        lang, q = self.vote(level, self.tree[fam], margin)
        return lang, float(min(1.0, max(0.0, p * q)))


def fit(labelled: DataFrame, *, lang: str = "lang", text: str = "text", per_language: int = 600) -> Model:
    """Learn from rows with a language and a text; rows without either are left out. All languages are
    learned: a row of weights (``DIM`` numbers) for every pair of families and of languages in one family."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("_t")).where("lang is not null and _t is not null")
    workers(labelled)
    sample = staged(sample_rows(rows, per_language), "langid")
    model = Model([r.lang for r in sample.select("lang").distinct().collect()])
    if model.machines:
        examples = sample.mapInArrow(_examples(model.machines), "machine string, y int, at array<int>, x array<double>")
        trained = staged(examples.groupBy("machine").applyInPandas(_train, "machine string, w array<double>, bias double"), "machines")
        for r in trained.toLocalIterator():  # one row per machine
            model.w[model.names[r.machine]], model.bias[model.names[r.machine]] = r.w, r.bias
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            langs, scores = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                if not t or not m.tree or not has_letter(t):
                    lang, p = "und", 0.0
                else:
                    lang, p = m.predict(features(t))
                langs.append(lang)
                scores.append(p)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names[:-1], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred (``und``: text null or without a letter, or
    nothing was learned), score (0 to 1; 0 for ``und``). Only the whole text is read for it."""
    shared = workers(docs).sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t")).mapInArrow(
        _predict(shared), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether the id's fold is kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             per_language: int = 600) -> DataFrame:
    """Learn from the rows outside the held-out fold that have a language, predict all rows.

    Adds held_out to ``predict``'s columns. Null languages are not learned from; null or letterless
    texts are ``und``; repeated rows each get their row; an empty table gives no rows; with one
    learned language every text with a letter gets it, with none all are ``und``; other columns
    are not read."""
    model = fit(docs.where(~held_out(F.col(doc_id))), lang=lang, text=text, per_language=per_language)
    return predict(docs, model, doc_id=doc_id, text=text).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
