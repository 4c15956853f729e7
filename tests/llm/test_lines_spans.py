"""Line deduplication and sentence spans against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import accumulate, chain

import numpy as np

from taxonspark.llm import linededup, spans

SCHEMA = "doc_id long, text string, source string, _host string, n_lines long, line string"


def lines_by_hand(docs, ratio, min_pages):
    pages, seen = Counter(), Counter()
    for _, text, host in docs:
        if host is not None:
            pages[host] += 1
            seen.update((host, x) for x in {x.strip(" \t\r") for x in (text or "").split("\n")} if x and text is not None)
    drop = {k for k, n in seen.items() if n >= min_pages and n > ratio * pages[k[0]]}
    out = []
    for d, text, host in docs:
        if text is None:
            out.append((d, None, 0, 0))
        else:
            all_lines = text.split("\n")
            kept = [x for x in all_lines if (host, x.strip(" \t\r")) not in drop]
            out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(1, None, "a"), (2, "", "a"), (3, "menu\n\n menu \nx", None), (None, "menu", "a"), (4, "\n\n", "b")]
    for i in range(5, 160):
        host = rng.choice("aaaab") if i % 7 else f"h{i}"
        text = "\n".join(rng.choice(("menu", " menu\t", "foot \r", f"own {i} {k}", "often" if rng.random() < 0.4 else "rare", "")) for k in range(rng.randrange(1, 9)))
        docs.append((i, text, host))
    docs += [docs[9], docs[9], (900, "\n".join(f"l{i}" for i in range(30_000)) + "\nmenu", "a")]
    df = spark.createDataFrame([(d, t, h, "zz", 7, "line") for d, t, h in docs], SCHEMA).repartition(4)
    for ratio, least in ((0.1, 3), (0.5, 1)):
        got = linededup.drop_boilerplate(df, ratio=ratio, min_pages=least, keep=["doc_id", "text"])
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == lines_by_hand(docs, ratio, least)
    everything = linededup.drop_boilerplate(df)
    assert everything.columns == ["doc_id", "text", "source", "_host", "line", "n_lines", "n_dropped"]
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def pieces(raw):
    """Byte offsets of the pieces of one text; of those, the ones that begin a sentence."""
    data = np.frombuffer(raw, np.uint8)
    _, bounds, start, _, whole = spans.sentences(data, np.array([0, len(raw)]))
    first = start[bounds[:-1]]
    return first.tolist(), first[whole].tolist()


def sentence_starts(raw):
    return pieces(raw)[0]


def test_sentences():
    raw = b"  One two. Three\nfour 3.5 a?b! Five"
    starts = sentence_starts(raw)
    for piece in (b"One two.", b"Three", b"four", b"Five"):
        assert raw.index(piece) in starts
    assert sentence_starts(b"") == [] and sentence_starts(b" \n ") == [] and sentence_starts(b"x") == [0]


def spans_by_hand(docs, run, min_words, long_words):
    """docs: (id, text), ids distinct; occurrences in order of (id, place). (id, text kept, pieces, pieces removed)."""
    seen, cut = defaultdict(list), {}
    for d, text in sorted(docs):
        raw = text.encode()
        starts, whole = pieces(raw)
        whole = set(whole)
        units = [raw[a:z].lower().split() for a, z in zip(starts, [*starts, len(raw)][1:], strict=True)]
        at = [0, *accumulate(map(len, units))]
        cut[d] = (raw, units, at, list(chain(*units)))
        for a in range(len(units)):
            for z in range(a + 1, len(units) + 1):
                words = sum(units[a:z], [])
                ended = z == len(units) or starts[z] in whole
                sentences = sum(starts[k] in whole for k in range(a, z)) if starts[a] in whole and ended else 0
                if z - a >= run and len(words) >= long_words or sentences >= run and len(words) >= min_words:
                    seen[tuple(words)].append((d, a, z))
                    break
    gone = defaultdict(list)
    for places in seen.values():
        first, *others = sorted(places)
        for d, a, z in others:
            gone[d].append((a, z, first))
    out = []
    for d, (raw, units, at, words) in cut.items():
        covered = {k for a, z, _ in gone[d] for k in range(a, z)}
        away = {w for k in covered for w in range(at[k], at[k + 1])}
        for k in sorted(covered):
            if k - 1 not in covered:  # the one run that starts here, then the last of those that end where the stretch ends
                end = next(e for e in range(k, len(units) + 1) if e not in covered)
                for side, (a, z, (fd, fa, fz)) in ((-1, next(g for g in gone[d] if g[0] == k)), (1, max(g for g in gone[d] if g[1] == end))):
                    _, _, places, theirs = cut[fd]
                    own, other = (at[a], places[fa]) if side < 0 else (at[z], places[fz])
                    for n in range(spans.CONTEXT):
                        i, j = (own - 1 - n, other - 1 - n) if side < 0 else (own + n, other + n)
                        if min(i, j) < 0 or i >= len(words) or j >= len(theirs) or words[i] != theirs[j]:
                            break
                        away.add(i)
        starts = [m.start() for m in re.finditer(rb"[^ \t-\r]+", raw)]
        bounds = [*starts, len(raw)]
        kept = raw[:bounds[0]] + b"".join(raw[bounds[k]:bounds[k + 1]] for k in range(len(starts)) if k not in away)
        out.append((d, kept.decode(), len(units), len(covered)))
    return sorted(out)


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]

    def sentence():
        return " ".join(rng.choice(vocab) for _ in range(rng.choice((1, 2, 4, 9, 14, 35)))) + rng.choice((".", "!", "?", "...", ""))

    passages = [" ".join(sentence() for _ in range(rng.choice((3, 5, 9)))) for _ in range(6)]
    docs = [(0, ""), (1, "  \n "), (2, "One."), (3, ". ! ?")]
    for i in range(4, 90):
        parts = [sentence() for _ in range(rng.randrange(0, 9))]
        for _ in range(rng.choice((0, 1, 2))):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        docs.append((i, rng.choice((" ", "\n", "\n\n ")).join(parts)))
    docs += [(200, docs[40][1]), (201, docs[40][1].upper()), (300, " ".join(rng.choice(vocab) + "." for _ in range(20_000)))]
    df = spark.createDataFrame([(d, t, "s", "h", 1, "l") for d, t in docs], SCHEMA).repartition(4)
    want = spans_by_hand(docs, 3, 12, 20)
    assert sum(r[3] for r in want) > 50
    assert sorted(tuple(r) for r in spans.drop_repeated_spans(df).collect()) == want


def test_spans_nulls_and_repeated_rows(spark):
    text = "A first sentence of several words here. Another sentence that has quite some words. And a third one with even more words in it."
    rows = [(1, text), (1, text), (None, text), (2, None), (3, text)]
    got = spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed == r.n_sentences) for r in got), key=str) == sorted(
        [(1, text, False), (1, text, False), (None, text, False), (2, None, True), (3, "", True)], key=str)
    assert {r.n_removed for r in got if r.doc_id != 3} == {0}
    assert spans.drop_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words_in(rng, letter, n):
    return " ".join(f"{letter}{rng.randrange(10 ** 6)}" for _ in range(n))


def test_passages_inside_other_text_go_to_their_own_ends(spark):
    """Passages of 51 words and more without a sentence end, wherever the text around them is cut."""
    rng = random.Random(9)
    passages = [words_in(rng, "p", 51 + k % 10) for k in range(60)]
    docs = [(i * 100 + k, f"{words_in(rng, 'o', rng.randrange(40))} {p} {words_in(rng, 'e', rng.randrange(40))}".strip())
            for k, p in enumerate(passages) for i in range(3)]
    got = {r.doc_id: r.text for r in spans.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        want = text if d < 100 else " ".join(w for w in text.split() if w[0] != "p")
        assert got[d].split() == want.split()


def test_three_short_sentences_go_a_common_line_stays(spark):
    rng = random.Random(3)
    short = "One two three four. Five six seven eight. Nine ten eleven twelve."
    line = "this single line of some fifteen words is common and no passage of several sentences."
    docs = [(i, f"{words_in(rng, 'a', 5)}.\n{line}\n{words_in(rng, 'b', 6)}. {short} {words_in(rng, 'c', 7)}.") for i in range(4)]
    got = {r.doc_id: r.text for r in spans.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    assert all(got[i] == docs[i][1].replace(short + " ", "") for i in (1, 2, 3))


def test_texts_of_one_id_and_of_one_word(spark):
    """Another text under the id of a copy has places of its own; a word over and over repeats within its text."""
    rng = random.Random(8)
    long = " ".join(words_in(rng, "l", 9) + "." for _ in range(30))
    got = spans.drop_repeated_spans(spark.createDataFrame([(1, long), (2, long), (2, "Short."), (3, "a " * 3000), (4, "a " * 10)], "doc_id long, text string")).collect()
    text = defaultdict(list)
    for r in got:
        text[r.doc_id].append(r.text)
    assert text[1] == [long] and sorted(text[2]) == ["", "Short."] and text[4] == ["a " * 10]
    assert 0 < len(text[3][0].split()) <= 32
