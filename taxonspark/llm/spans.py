"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after a word that ends in . ! or ? and at line ends. From every sentence on, the run of the
next ``run`` sentences is hashed (128 bits over lower-cased words); it goes on until it has ``min_words`` words, so that three
sentences of one word each are no passage. So that passages without such ends have runs too, sentences of ``LONG`` words or more
are cut into pieces, before every word whose hash is the least of some ``WINDOW`` consecutive words of the text. Such cuts
depend on the words around them alone, so they are the same in every copy of a passage, and no two of them are more than ``WINDOW``
words apart. From every piece on, ``run`` pieces or more that have ``long_words`` words are a run, if none of whole sentences ends
before: a line that is common is no passage by being cut.

A run that occurs more than once keeps its first occurrence, by (doc_id, place); the pieces that any other occurrence covers go.
A longer repeated passage is covered by its runs. Where a removed stretch begins and ends, it is extended word by word (by
``CONTEXT`` words at most) as long as the text agrees with what surrounds the run's first occurrence: a passage
that starts or ends in the middle of a sentence goes up to its own first and last word.

The hashes are grouped by a partial and a final aggregation, so a run in a third of all documents sends one row per task;
occurrences then meet the repeated runs in a join whose hot keys can be split. What surrounds a first occurrence is read once for
each of its edges, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, range_hashes, staged, text_chunks, word_hashes, workers

LONG = 12
WINDOW = 8
CONTEXT = 16  # words from a passage's end to the first cut that all its copies share: under 2 * WINDOW
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True  # ! . ?


def _least(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether a word has the least hash (the last of equal ones) of some ``WINDOW`` consecutive words of one text;
    ``text``: the text's number by word."""
    out, n = np.zeros(len(words), bool), len(words) - WINDOW + 1
    if n > 0:
        mixed = mix64(words)  # not the hash itself, whose order the words' lengths could sway
        best, place = mixed[:n].copy(), np.arange(n)
        for k in range(1, WINDOW):
            here = mixed[k:n + k]
            lower = here <= best
            best[lower] = here[lower]
            place[lower] = np.flatnonzero(lower) + k
        out[place[text[:n] == text[WINDOW - 1:]]] = True
    return out


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the texts ``data[at[i]:at[i + 1]]``: word hashes; the first word of every piece, with
    the number of words at the end; the byte offsets of the words; the number of the first
    piece of every text, with the total at the end; whether a piece begins a sentence."""
    words, start, end = word_hashes(data, at[:-1])
    if not len(words):
        return words, np.zeros(1, np.int64), start, np.zeros(len(at), np.int64), np.zeros(0, bool)
    lines = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=lines[1:])
    new = np.ones(len(words), bool)  # whether a sentence begins with this word
    new[1:] = _STOP[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]])
    texts = np.searchsorted(start, at[:-1])
    new[texts[texts < len(words)]] = True
    length = np.diff(np.append(np.flatnonzero(new), len(words)))
    whole = new.copy()
    new |= (np.repeat(length, length) >= LONG) & _least(words, np.searchsorted(at, start, "right"))
    first = np.flatnonzero(new)
    return words, np.append(first, len(words)), start, np.searchsorted(first, np.append(texts, len(words))), whole[first]


def runs(bounds: np.ndarray, texts: np.ndarray, whole: np.ndarray, run: int, min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first piece, end piece) of all runs; ``bounds``, ``texts`` and ``whole`` as ``sentences`` gives them."""
    n = len(bounds) - 1
    here = np.arange(n)
    end = np.maximum(np.searchsorted(bounds, bounds[:-1] + long_words), here + run)
    first = np.append(np.flatnonzero(whole), n)
    to = np.maximum(np.searchsorted(bounds[first], bounds[first[:-1]] + min_words), np.arange(len(first) - 1) + run)
    end[first[:-1]] = np.minimum(end[first[:-1]], np.append(first, n + 1)[np.minimum(to, len(first))])
    ok = end <= texts[np.searchsorted(texts, here, "right")]
    return here[ok], end[ok]


def _emit(*sizes: int):
    """mapInArrow (doc_id, text) -> (h1, h2, doc_id, at, again): every run; at: its first piece and
    length as one number; again: not the document's first such run."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            ids = b.column(0).to_numpy()
            for lo, data, at in text_chunks(b.column(1)):
                words, bounds, _, texts, whole = sentences(data, at)
                a, z = runs(bounds, texts, whole, *sizes)
                if not len(a):
                    continue
                text = np.searchsorted(texts, a, "right") - 1
                h1 = range_hashes(words, bounds[a], bounds[z])
                h2 = range_hashes(mix64(words ^ np.uint64(0xA0761D6478BD642F)), bounds[a], bounds[z])
                order = np.lexsort((a, h2, h1, text))
                again = np.zeros(len(a), bool)
                same = (text[order][1:] == text[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                again[order[1:]] = same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), pa.array(ids[lo + text]), pa.array((a - texts[text]) << 16 | (z - a)), pa.array(again)],
                    ["h1", "h2", "doc_id", "at", "again"])
    return go


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow (doc_id, text, edges) -> (first, edge, around): the hashes of the ``CONTEXT`` words, or fewer, before (edge even) or
    from (odd) the piece number edge / 2, nearest first."""
    for b in batches:
        ids, edges = b.column(0).to_pylist(), b.column(2)
        for lo, data, at in text_chunks(b.column(1)):
            words, bounds, _, texts, _ = sentences(data, at)
            rows = []
            for i in range(len(at) - 1):
                low, high = bounds[texts[i]], bounds[texts[i + 1]]
                for edge in edges[lo + i].as_py():
                    q = bounds[min(texts[i] + (edge >> 1), texts[i + 1])]
                    near = words[q:min(q + CONTEXT, high)] if edge & 1 else words[max(q - CONTEXT, low):q][::-1]
                    rows.append((ids[lo + i], edge, near.tobytes()))
            first, edge, around = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(edge, pa.int64()), pa.array(around, pa.binary())],
                                             ["first", "edge", "around"])


def _agreeing(words: np.ndarray, around: bytes) -> int:
    """How many of ``words``, nearest first, agree with ``around``."""
    near = np.frombuffer(around, np.uint64)
    n = min(len(near), len(words))
    differ = np.flatnonzero(words[:n] != near[:n])
    return int(differ[0]) if len(differ) else n


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow (doc_id, text, runs to remove, edges to extend) -> doc_id, text, n_sentences, n_removed."""
    for b in batches:
        valid, drops, edges = b.column(1).is_valid().to_pylist(), b.column(2), b.column(3)
        for lo, data, at in text_chunks(b.column(1)):
            words, bounds, start, texts, _ = sentences(data, at)
            out, total, removed = [], np.diff(texts), np.zeros(len(at) - 1, np.int64)
            raw = data.tobytes()
            for i in range(len(at) - 1):
                t = raw[at[i]:at[i + 1]]
                gone = drops[lo + i].values.to_numpy() if drops[lo + i].is_valid else np.zeros(0, np.int64)
                gone = gone[(gone >> 16) + (gone & 0xFFFF) <= total[i]]  # another text of the same id has others
                if len(gone):
                    here = bounds[texts[i]:texts[i + 1] + 1]
                    low, high = here[0], here[-1]
                    depth = np.zeros(high - low + 1, np.int64)
                    np.add.at(depth, here[gone >> 16] - low, 1)
                    np.add.at(depth, here[(gone >> 16) + (gone & 0xFFFF)] - low, -1)
                    away = np.cumsum(depth[:-1]) > 0
                    removed[i] = away[here[:-1] - low].sum()
                    for e in edges[lo + i].as_py() or ():
                        q = here[min(e["own"] >> 1, total[i])]
                        if e["own"] & 1:
                            away[q - low:q - low + _agreeing(words[q:min(q + CONTEXT, high)], e["around"])] = True
                        else:
                            away[q - low - _agreeing(words[max(q - CONTEXT, low):q][::-1], e["around"]):q - low] = True
                    place = np.append(start[low:high], at[i + 1]) - at[i]
                    turn = np.flatnonzero(np.diff(np.concatenate(([True], away, [True]))))  # where kept words begin and end
                    t = t[:place[0]] + b"".join([t[place[turn[k]]:place[turn[k + 1]]] for k in range(0, len(turn), 2)])
                out.append(t.decode("utf-8", "replace") if valid[lo + i] else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, len(out)), pa.array(out, pa.string()), pa.array(total.astype(np.int64)), pa.array(removed)],
                ["doc_id", "text", "n_sentences", "n_removed"])


def _edges(docs: DataFrame, hits: DataFrame, gone: DataFrame) -> DataFrame:
    """(_e, _edges): by document the edges of its removed stretches (twice the piece's number, odd at an end) with the words around the
    first occurrence of the run there."""
    first = hits.where("doc_id = first and not again").groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("at").alias("_f"))
    start, size = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(0xFFFF))
    one = gone.groupBy("doc_id", "at").agg(F.min(F.struct("h1", "h2")).alias("_h")).select("doc_id", "at", "_h.*")
    by = Window.partitionBy("doc_id").orderBy("at")  # one document's runs
    before = F.max(start + size).over(by.rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("_new", F.coalesce(start > before, F.lit(True))).withColumn("_g", F.sum(F.col("_new").cast("int")).over(by))
    f_start, f_size = F.shiftright("_f", 16), F.col("_f").bitwiseAND(F.lit(0xFFFF))
    one = one.groupBy("doc_id", "_g").agg(F.min(F.struct(start.alias("own"), "h1", "h2")).alias("_a"), F.max(F.struct((start + size).alias("own"), "at", "h1", "h2")).alias("_z"))
    sides = F.array(F.struct((F.col("_a.own") * 2).alias("own"), "_a.h1", "_a.h2"), F.struct((F.col("_z.own") * 2 + 1).alias("own"), "_z.h1", "_z.h2"))
    one = one.select("doc_id", F.explode(sides).alias("_s")).select("doc_id", "_s.*").join(first, ["h1", "h2"])
    one = one.select("doc_id", "first", "own", F.when(F.col("own") % 2 == 0, f_start * 2).otherwise((f_start + f_size) * 2 + 1).alias("edge"))
    one = staged(one, "edges")
    wanted = one.groupBy(F.col("first").alias("_w")).agg(F.collect_set("edge").alias("_edges"))
    texts = docs.join(wanted, F.col("doc_id") == F.col("_w")).select("doc_id", "_t", "_edges")
    around = texts.mapInArrow(_surroundings, "first long, edge long, around binary").groupBy("first", "edge").agg(F.min("around").alias("around"))
    known = one.join(staged(around, "around"), ["first", "edge"])
    return known.groupBy(F.col("doc_id").alias("_e")).agg(F.collect_list(F.struct("own", "around")).alias("_edges"))


def drop_repeated_spans(docs: DataFrame, *, run: int = 3, min_words: int = 12, long_words: int = 20, doc_id: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the pieces of non-first repeated runs (and the words beside them
    that the first occurrence has there too), n_sentences (pieces), n_removed (whole pieces, without such words).

    Null texts stay null with 0 pieces; rows without id stay whole and are no one's first
    occurrence; rows of one id are one document (equal rows are cut alike); a text that is
    all repeated becomes empty; an empty table gives no rows; other columns are not read."""
    workers(docs)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_t"))
    spans = docs.mapInArrow(_emit(run, min_words, long_words), "h1 long, h2 long, doc_id long, at long, again boolean")
    whole = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("within"))
    repeated = staged(whole.where("first < last or within").select("h1", "h2", "first"), "runs")
    hits = staged(spans.join(repeated, ["h1", "h2"]), "hits")
    gone = hits.where("again or doc_id <> first")
    drops = gone.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("at").alias("_at"))
    marked = docs.join(drops, F.col("doc_id") == F.col("_d"), "left").join(_edges(docs, hits, gone), F.col("doc_id") == F.col("_e"), "left")
    return marked.select("doc_id", "_t", "_at", "_edges").mapInArrow(_cut, "doc_id long, text string, n_sentences long, n_removed long")
