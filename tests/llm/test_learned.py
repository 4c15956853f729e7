"""Language ID, licences, mixing and the lattice: accuracy, brute force and odd rows."""

import math
import re
import zlib

import numpy as np
import regex
import pytest
from pyspark.sql import functions as F

from taxonspark.llm import langid, lattice, licenses, mixing

DOCS = "doc_id long, text string, lang string, source string, score string, lang_pred string"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(held) > 250 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98


def test_language_odd_rows(spark):
    rows = [(i, t, lang, "s", "x", "y") for i, (t, lang) in enumerate(
        [("the house of the man and the dog", "en"), ("das Haus und der Hund des Mannes", "de"), ("la maison et le chien de la femme", "fr")] * 8)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !!! …", "de"), (103, "the dog", None), (None, "le chien", "fr"), (104, "Ωμέγα", "xx"),
           (103, "the dog", None), (105, "la maison " * 60_000, "fr")]
    df = spark.createDataFrame(rows + [(*r, "s", "x", "y") for r in odd], DOCS)
    got = {}
    for r in langid.identify(df).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert [x[1] for k in (100, 101, 102) for x in got[k]] == ["und"] * 3 and got[None][0][0] is False
    assert len(got[103]) == 2 and got[103][0] == got[103][1]
    assert got[103][0][1] == "en" and got[105][0][1] == "fr" and got[None][0][1] == "fr"
    # the label, id and source of a row don't matter to its prediction
    model = langid.fit(df.where("lang is not null"))
    asked = spark.createDataFrame([(1, "der Hund", "en", "z", "", ""), (2, "der Hund", None, None, "", "")], DOCS)
    assert len({(r.lang_pred, r.score) for r in langid.predict(asked, model).collect()}) == 1


def test_language_of_many(spark):
    """All labelled languages are learned, however many there are."""
    codes = [f"q{a}{b}" for a in "abcdefgh" for b in "abcdefghi"]
    words = {c: ["".join(chr(97 + zlib.crc32(f"{c}{w}{i}".encode()) % 26) for i in range(6)) for w in range(6)] for c in codes}
    rows = [(100 * k + i, " ".join(words[c][(i + j) % 6] for j in range(5)), c, "s", "", "") for k, c in enumerate(codes) for i in range(3)]
    got = langid.predict(spark.createDataFrame(rows, DOCS), langid.fit(spark.createDataFrame(rows, DOCS))).collect()
    assert len(codes) > 64 and {r.doc_id: r.lang_pred for r in got} == {r[0]: r[2] for r in rows}


def test_language_sample_is_bounded(spark):
    texts = [("en", "the copy that a third of the rows hold")] * 300 + [("en", f"text {i}") for i in range(300)] + [("de", f"Wort {i}") for i in range(5)]
    rows = spark.createDataFrame(texts, "lang string, t string").select("lang", F.col("t").cast("binary").alias("_t"))
    got = [(r.lang, bytes(r._t)) for r in langid.sample_rows(rows, 50).collect()]
    assert len(set(got)) == len(got) == 55 and sum(x == "en" for x, _ in got) == 50


def test_letters():
    yes, no = ("a", "1É", "ß", "中", "Ω1"), ("", "1", "²½", "_-", "€ 5", "١٢", "🙂")
    assert all(langid.has_letter(t.encode()) for t in yes) and not any(langid.has_letter(t.encode()) for t in no)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", "", ""), (2, None, None, "s", "", "")], DOCS)
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    one = spark.createDataFrame([(k, "some text", "en", "s", "", "") for k in range(6)], DOCS)
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"en"}
    assert langid.identify(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_licenses(spark, license_model):
    lines = [(f, t) for f, t in licenses.TEMPLATES]
    other = ["The dog sleeps under the table of the house.", "Elections were held under public supervision.", "", "-- 12 --"]
    rows = [(i, "Some first words here.\n" + t + "\nand a last line", "x") for i, (_, t) in enumerate(lines)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "\n".join(other), "x"), (None, "ok\nReleased under the MIT License.", "x"),
             (903, "word " * 200_000 + "released under the MIT License.", "x"), (0, rows[0][1], "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string"), model=license_model).collect()
    known = [r for r in got if r.family != "unknown"]
    right = {r.doc_id for r in known if r.doc_id is not None and r.doc_id < len(lines) and r.family == lines[r.doc_id][0] and r.confirmed and r.paragraph == 1}
    assert len(right) >= len(lines) - 2
    assert not [r for r in known if r.doc_id in (900, 901, 902)]
    assert len([r for r in known if r.doc_id == 0]) == 2 and [r.family for r in known if r.doc_id is None] == ["mit"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"), model=license_model).count() == 0


def brute_paragraphs(text):
    """Lines joined to the next one unless they end a sentence or either is blank."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if out and line.strip() and out[-1].strip() and not re.search(r"[.:;!?]\s*$", out[-1]):
            out[-1] += " " + line
        else:
            out.append(line)
    return out


WRAPPED = {
    "bsd": "// Redistribution and use in source and\n// binary forms, with or without\n// modification, are permitted provided\n// that the following conditions are met:\n",
    "gpl": " * This program is free software: you can\r\n * redistribute it and/or modify it\r\n * under the terms of the GNU General\r\n * Public License as published\r\n",
    "mit": "Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated\ndocumentation files (the \"Software\"),\nto deal",
}


def test_wrapped_notices_are_one_paragraph(spark, license_model):
    rows = [(i, f"Some words here.\n\n{t}\n\nAnd more words.", f) for i, (f, t) in enumerate(WRAPPED.items())]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, f string"), model=license_model).where("confirmed").collect()}
    assert {i: r.family for i, r in got.items()} == dict(enumerate(WRAPPED)) and all(r.paragraph == 2 for r in got.values())


def test_words_of_other_scripts_and_numbers_are_no_licences(spark, license_model):
    rows = [(0, "Версия 2 и 0 или 3."), (1, "2 0 2 0"), (2, "version 2 0"), (3, "The software of the house."), (4, "of the under the to the")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=license_model).collect()
    assert not [r for r in got if r.family != "unknown" or r.doc_id in (0, 1, 3)]


def test_document_frequencies_are_whole(spark):
    docs = spark.createDataFrame([("all rights reserved. all rights",), ("all rights\nreserved",), ("rights all",), ("",)], "_t string")
    assert licenses.document_frequencies(docs, ["all rights", "rights reserved"]) == {"all rights": 2, "rights reserved": 2, "all": 3, "rights": 3, "reserved": 2}


def test_license_margins_by_hand(spark, license_model):
    """Left-out paragraphs and grouped sums give what the model says of every single paragraph."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {(r.doc_id, r.paragraph): (r.family, r.probability) for r in licenses.scan(docs, model=license_model).collect()}
    m, found = license_model, 0
    for d in docs.collect():
        for k, line in enumerate(brute_paragraphs(d.text or "")):
            w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", line.lower()) if x]
            grams = {" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
            assert ((d.doc_id, k) in got) == bool(grams & set(m.telling))
            margin = np.array(m.bias) + sum((m.weights[g] for g in grams if g in m.weights), np.zeros(len(m.families)))
            p = 1 / (1 + math.exp(-(m.scale * margin.max() + m.offset)))
            if p >= 0.5:
                found += 1
                assert got[d.doc_id, k][0] == m.families[int(margin.argmax())] and abs(got[d.doc_id, k][1] - p) < 1e-5
            elif (d.doc_id, k) in got:
                assert got[d.doc_id, k][0] == "unknown"
    assert found == sum(f != "unknown" for f, _ in got.values())


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.3, 0.3, 0.2), 3000)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(rng.integers(0, 900, 3000), p, strict=True)]
    df = spark.createDataFrame(rows, "tokens long, p array<double>")
    tokens = np.array([r[0] for r in rows], float)
    for share in ((0.6, 0.3, 0.1), (0.9, 0.05, 0.05), (1 / 3, 1 / 3, 1 / 3)):
        got = mixing.fit_rates(df, np.array(share) * tokens.sum()).collect()
        rate, q, n = (np.array([r[k] for r in got], float) for k in ("rate", "p", "tokens"))
        assert rate.min() >= 0 and np.abs((rate * n) @ q / tokens.sum() - share).max() < 1e-4


def test_mixing_of_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("domain", F.lit("x")).withColumn("rate", F.lit(9))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = labels.where("doc_id % 4 <> 0")
    got = mixing.mix(docs, known)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(abs(sum(r.posterior.values()) - 1) < 1e-6 and r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows.values())
    held = labels.where("doc_id % 4 = 0").collect()
    toxic, clean = ([rows[r.doc_id].rate for r in held if r.toxic == t] for t in (1, 0))
    assert np.mean(toxic) < 0.4 * np.mean(clean)
    total = sum(r.n_tokens for r in rows.values())
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r.posterior[d] for r in rows.values()) / total - share) < 1e-3


def test_mixing_learns_rare_domains(spark):
    """A domain of 6 in 3,006 labelled documents is learned from a sample of 60, and stays rare in the posteriors."""
    rows = [(i, f"ordinary words of number {i % 17} stand here") for i in range(3000)] + [(5000 + i, f"vile words of number {i} stand here") for i in range(6)]
    labels = [(i, 1, 0) for i in range(3000)] + [(5000 + i, 0, 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing.mix(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_train=60).collect()
    toxic = {r.doc_id: r.posterior["toxic"] for r in got}
    assert min(toxic[5000 + i] for i in range(6)) > 10 * max(toxic[i] for i in range(3000))
    assert 0 < sum(toxic.values()) < 60


def test_mixing_odd_rows(spark):
    rows = [(1, "good text", "a"), (2, None, "a"), (3, "", "a"), (None, "bad text", "a"), (1, "good text", "a"), (4, "w " * 200_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.domain, r.rate) for r in mixing.mix(docs, none).collect()} == {("unknown", 1.0)}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 1), (9, None, None), (4, 0, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    assert mixing.mix(docs.limit(0), labels).count() == 0
    only = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.domain for r in mixing.mix(docs, only).collect()} == {"good"}


def lattice_by_hand(rows, threshold=0.98):
    ok = {}
    for i, v, l in rows:
        if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (l, np.array(v, float))
    links = {i: set() for i in ok}
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (la, va), (lb, vb) = ok[a], ok[b]
            if la == lb and len(va) == len(vb) and va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return sorted(((i, len(links.get(i, ())), comp.get(i, i), i is not None and comp.get(i, i) == i) for i, _, _ in rows), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_lattice_equals_brute_force(spark, block):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        base = rng.standard_normal(24)
        for _ in range(int(rng.choice((1, 3, 10, 60)))):
            v = (base + rng.standard_normal(24) * rng.choice((0.0, 0.02, 0.06))) * rng.choice((0.5, 1.0, 3.0))
            rows.append((len(rows), [float(x) for x in v], c % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] + [1.0] * 23, 1), (1004, [None] + [1.0] * 23, 1),
             (1005, [float("inf")] + [1.0] * 23, 1), (1006, rows[0][1], None), (None, rows[0][1], 0), (1007, rows[0][1], 0), (1008, rows[0][1], 0),
             (1009, rows[0][1][:12], 0), (1010, rows[0][1][:12], 0), rows[2], rows[2]]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, cells string, n int").repartition(4)
    got = sorted((tuple(r) for r in lattice.near_duplicates(df, block=block).collect()), key=str)
    assert got == lattice_by_hand(rows)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    near = lattice._minimal_vectors()
    assert len(near) == 240 and len(np.unique(near, axis=0)) == 240 and np.allclose((near ** 2).sum(axis=1), 2)
    x = rng.uniform(-5, 5, (500, 8))
    c = lattice.nearest_e8(x)
    assert (np.rint(2 * c) == 2 * c).all() and (c.sum(axis=1) % 2 == 0).all()
    d = ((x - c) ** 2).sum(axis=1)
    assert (d[:, None] <= ((x[:, None, :] - c[:, None, :] - near) ** 2).sum(axis=2) + 1e-12).all() and d.max() <= 1.0 + 1e-9


def test_lattice_recall(spark):
    """Pairs at cosines just above the threshold, by band, and around hubs: at least nine in ten are linked, none below."""
    rng = np.random.default_rng(11)
    for dims in (16, 64):
        vectors, bands = [], {}
        for cosine in (0.9801, 0.985, 0.99, 0.999):
            for _ in range(250):
                a, b = rng.standard_normal((2, dims))
                a /= np.linalg.norm(a)
                b -= a * (a @ b)
                bands[len(vectors)] = cosine
                vectors += [a, cosine * a + math.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b)]
        for _ in range(12):
            hub = rng.standard_normal(dims)
            vectors += [hub / np.linalg.norm(hub) + 0.09 / math.sqrt(dims) * rng.standard_normal(dims) for _ in range(40)]
        x = np.array(vectors)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want = ((x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)).sum(axis=1)
        rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
        got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert all(got[i] <= n for i, n in enumerate(want.tolist())) and sum(got.values()) >= 0.9 * want.sum()
        for cosine in set(bands.values()):
            mine = [i for i, c in bands.items() if c == cosine]
            assert sum(got[i] > 0 for i in mine) >= 0.9 * len(mine), (dims, cosine)
