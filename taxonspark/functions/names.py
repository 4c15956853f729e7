"""The best of many names for a text: exact Jaro-Winkler maxima without comparing the text with every name.

Names are sorted by their beginning, then by their characters, and cut into small groups of one 4-character beginning. The (character,
occurrence) items of a group's names, as bits, its shortest and longest name and its beginning bound Jaro-Winkler for all its names at
once. The names around a text in the order of the alphabet are compared first. Runs of neighbouring groups are bounded alike, so that a text looks only at the groups of runs whose bound reaches the best score so
far, name by name only at groups whose own bound does, and only names whose bound does are compared. Bounds and comparisons are made for a
batch of texts together. The vectors' lengths bound a cosine; texts for which that leaves many names get float32 products with all of them,
raised by what rounding can hide. Only pairs that are compared get their cosine in double precision.

A long text matches each name's characters in the order in which it first shows them, whatever the name: the r-th occurrence of a
character in the text takes the r-th one in the name. Matches and transpositions of a name then depend on those of its
characters that the text has, so names that agree in them are compared once (``_Cells``, kept for texts that lack the same characters).

Names that differ only in characters that a text lacks are alike to it, whatever its length: if they are many, it meets one of each kind
(an index of its own, kept for all texts that lack these characters). Among many names of other kinds, a long text compares those first
that could have the best score if they had no transpositions, then only those that could still reach it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from .similarity import BOOST_GATE, CELLS, MAX_PREFIX, PREFIX_WEIGHT, _jaro_winkler_rows, encode_names
from .text import PY_WHITESPACE

#: names in a group; groups looked at first, names of them compared first, and names compared before the rest is judged again
GROUP, FIRST_GROUPS, FIRST, NEXT = 16, 4, 4, 8
#: names around a text that are compared first; groups in a run, runs looked at first, and the share of the names beyond which a text with a vector gets the products with all
AROUND, RUN, FIRST_RUNS, SHARE = 8, 16, 2, 16
#: texts, (text, group) bounds and (text, name) bounds worked on together; words of 64 bits for the items of a name
TEXTS, BOUNDS, PAIRS_AT_ONCE, WORDS = 512, 1_000_000, 500_000, 4
#: names whose matches are found in one step
ROWS = 4096
#: room for rounding in the bounds, which are float32; and of a float32 product, by dimension and norms (twice its unit roundoff)
SLACK, ROUNDING = 1e-5, 2.0 ** -23
#: (text, name) pairs compared in one step; cells of a name table that are kept, and kinds of texts
PAIRS, KEPT_CELLS, SEEN = 4_096, 4_000_000, 100_000
#: names of which some are left out for texts that can't tell them apart, if at most one of ``FEWER`` is left; names that are kept for such texts
MANY, FEWER, KEPT_NAMES = 1024, 8, 1_000_000


def best_of(score: np.ndarray, rank: np.ndarray) -> tuple[int, float]:
    """(position, score) of the highest score, among equals of the lowest rank; (-1, NaN) if there is no finite one. NaN never wins."""
    s = np.where(np.isfinite(score), score, -np.inf)
    top = s.max(initial=-np.inf)
    if top == -np.inf:
        return -1, float("nan")
    at = np.flatnonzero(s == top)
    return int(at[rank[at].argmin()]), float(top)


def _jw(m, t, la, lens, prefix):
    """Jaro-Winkler from matches, half transpositions, lengths and common prefix (a function of rows, if that is to be found where it
    matters only): the arithmetic of ``functions/similarity``."""
    mf = np.asarray(m, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (mf / la + mf / lens + (mf - t) / mf) / 3.0
    sim = np.where((mf > 0) & (lens > 0), sim, 0.0)
    if callable(prefix):
        at = np.flatnonzero(sim > BOOST_GATE)
        sim[at] += prefix(at) * PREFIX_WEIGHT * (1.0 - sim[at])
        return sim
    return np.where(sim > BOOST_GATE, sim + prefix * PREFIX_WEIGHT * (1.0 - sim), sim)


def _points(a: str) -> np.ndarray:
    return np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


#: the place of a character that is not matched; a place and a character as one number
_NEVER, _SHIFT = np.int64(1 << 40), 21


def _half_transpositions(place: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Half the places at which the matched ``chars`` (a row per name, ``place`` in the text) stand in another order in the text."""
    hit = place < _NEVER
    char = np.where(hit, chars, 0).astype(np.int64)
    shown = np.sort(np.where(hit, place, _NEVER) << _SHIFT | char, axis=1) & ((1 << _SHIFT) - 1)
    if not hit.all():
        order = np.arange(chars.shape[1], dtype=np.int64)[None, :]
        char = np.sort(np.where(hit, order, _NEVER) << _SHIFT | char, axis=1) & ((1 << _SHIFT) - 1)
    return (shown != char).sum(axis=1) // 2


def _half_moved(order: np.ndarray, by_order: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The same from small numbers: the ``order`` of the characters in the text (the last of ``by_order`` for those not matched: -1), and
    the matched ``chars`` in the order of the name, then -1."""
    return _count(by_order[np.sort(order, axis=1)] != chars) // 2


def _count(x: np.ndarray) -> np.ndarray:
    """How many of each row are true."""
    return (x.astype(np.float32) @ np.ones(x.shape[1], np.float32)).astype(np.int64)


def _ordered(where: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in the text of items at the places ``where`` (-1: none), one more for the padding, and the ``chars`` in that order, then -1."""
    at = np.argsort(where, kind="stable")[np.count_nonzero(where < 0):]
    order = np.full(len(where) + 1, len(at), np.uint16 if len(at) < 1 << 16 else np.int64)
    order[at] = np.arange(len(at))
    return order, np.append(chars[at], -1)


def likeness(name: str) -> tuple[str, str, str]:
    """Sorts names of one beginning by their characters, whatever their order: neighbours share most of them."""
    return name[:MAX_PREFIX], "".join(sorted(name, reverse=True)), name


class NameIndex:
    """Names in the order of their ``likeness`` (``rank``: the place of each in the list given)."""

    #: of an index of some names of another one: where they stand there
    among: np.ndarray | None = None

    def __init__(self, names: list[str]):
        stripped = [(x or "").strip(PY_WHITESPACE) for x in names]
        order = [likeness(x) for x in stripped]
        self.rank = np.array(sorted(range(len(names)), key=order.__getitem__), dtype=np.int64)
        self.mat, self.lens = encode_names([stripped[i] for i in self.rank])
        n, self.width = self.mat.shape
        self.spelled = np.array(sorted(range(n), key=lambda i: stripped[self.rank[i]]), dtype=np.int64)
        self.spellings = [stripped[self.rank[i]] for i in self.spelled]
        self.names = [stripped[i] for i in self.rank]
        chars = np.unique(self.mat)
        self.chars = chars[chars >= 0]
        self.column = {chr(int(c)): k for k, c in enumerate(self.chars)}
        at = np.searchsorted(self.chars, self.mat).astype(np.int32)  # -1 (padding) goes to 0 and is masked
        inside = np.arange(self.width)[None, :] < self.lens[:, None]
        # which occurrence of its character each place is: items are (character, occurrence)
        order = np.argsort(self.mat, axis=1, kind="stable")
        occurrence = np.zeros(self.mat.shape, dtype=np.int32)
        np.put_along_axis(occurrence, order, _occurrences(np.take_along_axis(self.mat, order, axis=1)).astype(np.int32), axis=1)
        self.deep = deep = int(occurrence[inside].max(initial=0)) + 1
        code = np.where(inside, at * deep + occurrence, -1)
        kinds = np.unique(code)
        self.kinds = kinds[kinds >= 0]
        self.items = np.where(inside, np.searchsorted(self.kinds, code), -1).astype(np.int32)
        self.wanted: dict[str, list[int]] = {}
        for k, kind in enumerate(self.kinds.tolist()):
            self.wanted.setdefault(chr(int(self.chars[kind // deep])), []).append(k)
        width = min(MAX_PREFIX, self.width)
        self.begin = self.mat[:, :width]
        change = np.ones(n, dtype=bool)
        change[1:] = (self.begin[1:] != self.begin[:-1]).any(axis=1)
        start = np.maximum.accumulate(np.where(change, np.arange(n), 0)) if n else np.empty(0, np.int64)
        self.starts = np.flatnonzero((np.arange(n) - start) % GROUP == 0)
        self.stops = np.append(self.starts[1:], n)
        # shared bits and the items that have none of their own bound the shared characters; a group has its names' bits
        self.bits = _bits(self.items, max(1, min(WORDS, -(-len(self.kinds) // 64))))
        self.excess = (self.lens - np.bitwise_count(self.bits).sum(axis=0, dtype=np.int64)).astype(np.int16)
        if n:
            self.group_bits = np.bitwise_or.reduceat(self.bits, self.starts, axis=1)
            self.group_excess = np.maximum.reduceat(self.excess, self.starts)
            self.lengths = self.lens.astype(np.float32)
            self.shortest = np.minimum.reduceat(self.lengths, self.starts)
            self.longest = np.maximum.reduceat(self.lengths, self.starts)
            self.largest = int((self.stops - self.starts).max())
            # runs of groups that begin alike
            self.runs = np.flatnonzero((self.starts - start[self.starts]) % (GROUP * RUN) == 0)
            self.run_size = np.diff(np.append(self.runs, len(self.starts)))
            self.run_bits = np.bitwise_or.reduceat(self.group_bits, self.runs, axis=1)
            self.run_excess = np.maximum.reduceat(self.group_excess, self.runs)
            self.run_shortest = np.minimum.reduceat(self.shortest, self.runs)
            self.run_longest = np.maximum.reduceat(self.longest, self.runs)
        self.begins, self.begin_id = np.unique(self.begin, axis=0, return_inverse=True)
        self.begin_id = self.begin_id.reshape(-1)
        self._cells: dict[bytes, _Cells] = {}
        self._seen: set[bytes] = set()
        self._kept = 0
        self._fewer: list[tuple[int, NameIndex]] = []
        self._told: dict[int, NameIndex | None] = {}
        self._vain: list[int] = []
        self._by_rank: tuple | None = None

    def best(self, texts: list[str], cos: np.ndarray | Cosines | None, w: float, has=None, floor=None) -> list[tuple[int, float]]:
        """(position, score) of the best name for each text by ``w * cos + (1 - w) * Jaro-Winkler``, clipped to [0, 1]. ``cos`` (texts x
        names, in the index's order) or None: 0 everywhere; it is 0 in the rows of texts without ``has``. ``floor``: a score that each text
        has elsewhere (NaN: none); where no name reaches it, there may be no best one."""
        cos = Cosines(cos) if isinstance(cos, np.ndarray) else cos
        out: list = [None] * len(texts)
        stripped = [(text or "").strip(PY_WHITESPACE) for text in texts]
        short, few = [], {}
        for i in sorted(range(len(texts)), key=lambda i: not self.is_long(stripped[i])):  # long texts first: short ones use what was made for them
            a = stripped[i]
            plain = cos is None or (has is not None and not has[i])
            if a and plain and (fewer := self._without(a)) is not None:
                few.setdefault(id(fewer), (fewer, []))[1].append(i)
                continue
            if a and not self.is_long(a):
                short.append((i, a))
                continue
            c = None if plain else cos.row(i)
            out[i] = self._best_cell(a, c, w) if a else best_of(np.clip(np.zeros(len(self.rank)) if c is None else w * c, 0.0, 1.0), self.rank)
        for fewer, on in few.values():
            found = fewer.best([stripped[i] for i in on], None, w, None, None if floor is None else np.asarray(floor, dtype=np.float64)[on])
            for i, (p, s) in zip(on, found, strict=True):
                out[i] = (int(fewer.among[p]), s) if p >= 0 else (p, s)
        if short and len(self.rank):
            on = np.array([i for i, _ in short])
            top = np.full(len(short), -1.0) if floor is None else np.fmax(-1.0, np.asarray(floor, dtype=np.float64)[on])
            for (i, _), got in zip(short, self._best_grouped([a for _, a in short], cos, on, w, top), strict=True):
                out[i] = got
        return [(-1, float("nan")) if x is None else x for x in out]

    def is_long(self, text: str) -> bool:
        """Whether the windows of every name reach its beginning."""
        return len(text) // 2 - 1 >= self.width

    # ------------------------------------------------------------------ names that a text can't tell apart

    def _without(self, a: str) -> NameIndex | None:
        """The index of one name of each kind that ``a`` can tell apart, if these are much fewer than the names. Short texts only
        use what was made for long ones, which it saves more than it costs."""
        if self.among is not None or len(self.rank) < MANY or not (self._fewer or self.is_long(a)):
            return None
        if len(self.column) > 256:
            has = set(self.column).intersection(a)
            lacks = sum(1 << k for ch, k in self.column.items() if ch not in has)
        else:
            lacks = sum(1 << k for ch, k in self.column.items() if ch not in a)
        if lacks in self._told:
            return self._told[lacks]
        got = next((fewer for chars, fewer in self._fewer if not chars & ~lacks), None)
        if got is None:
            if not self.is_long(a):
                return None
            if all(lacks & ~vain for vain in self._vain):
                got = self._reduced(lacks)
        if len(self._told) > SEEN:
            self._told.clear()
        self._told[lacks] = got
        return got

    def _reduced(self, lacks: int) -> NameIndex | None:
        """The index for texts without the characters ``lacks`` (bits), or without some of them: those that others lack too do almost as well."""
        kinds = self._kinds_without(lacks, len(self.rank) // FEWER)
        if kinds is None:
            self._vain = [v for v in self._vain if v & ~lacks][-SEEN:] + [lacks]
            return None
        for chars, _ in self._fewer[-16:]:
            some = self._kinds_without(lacks & chars, 2 * len(kinds)) if lacks & chars not in (0, lacks) else None
            if some is not None:
                lacks, kinds = lacks & chars, some
                break
        fewer = NameIndex([self.names[i] for i in kinds])
        fewer.among = kinds[fewer.rank]
        self._fewer.append((lacks, fewer))
        while len(self._fewer) > 1 and sum(len(f.rank) for _, f in self._fewer) > KEPT_NAMES:
            self._fewer.pop(0)
            self._told.clear()
        return fewer

    def _kinds_without(self, lacks: int, most: int) -> np.ndarray | None:
        """The first (by rank) of the names that differ only in the characters ``lacks``, in the order of their rank; None if they are over ``most``."""
        if self._by_rank is None:
            by_rank = np.argsort(self.rank)
            at = np.where(self.mat < 0, len(self.chars), np.searchsorted(self.chars, self.mat))[by_rank]
            self._by_rank = by_rank, at, np.random.default_rng(11).integers(1 << 62, size=(self.width, len(self.chars) + 1), dtype=np.uint64)
        by_rank, at, numbers = self._by_rank
        shown = np.array([not lacks >> k & 1 for k in range(len(self.chars))] + [True])
        numbers = np.where(shown, numbers, np.uint64(0))
        print_of = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            print_of += numbers[k][at[:, k]]
        prints, first = np.unique(print_of, return_index=True)
        if len(prints) > most:
            return None
        char = np.append(np.where(shown[:-1], np.arange(len(self.chars)), -1), len(self.chars))[at]
        if not (char == char[first[np.searchsorted(prints, print_of)]]).all():  # other names of an equal fingerprint
            return None
        return by_rank[np.sort(first)]

    # ------------------------------------------------------------------ long texts

    def _long(self, a: str):
        """(places of the items in ``a``, characters that only the late windows can add)."""
        window = len(a) // 2 - 1  # of every name, as the text is longer than all
        tail = a[window + 1:window + self.width]  # reached by the windows of later places of a name only
        where, late = np.full(len(self.kinds), -1, dtype=np.int64), set()
        for ch, kinds in self.wanted.items():
            p = -1
            for k in kinds:
                p = a.find(ch, p + 1, window + 1)
                if p < 0:
                    if ch in tail:
                        late.add(ch)
                    break
                where[k] = p
        return where, late

    def _kept_cells(self, present: np.ndarray):
        """The cells of texts with the items ``present``, or None if no other text of these was seen before."""
        key = present.tobytes()
        cells = self._cells.pop(key, None)
        if cells is None:
            cells = _Cells(self, present) if key in self._seen else None
            if len(self._seen) > SEEN:
                self._seen.clear()
            self._seen.add(key)
            if cells is None:
                return None
            self._kept += cells.size
            while self._cells and self._kept > KEPT_CELLS:  # the largest go first, the oldest of equals
                gone = max(self._cells, key=lambda k: self._cells[k].size)
                self._kept -= self._cells.pop(gone).size
        self._cells[key] = cells
        return cells

    def _best_cell(self, a: str, c, w: float) -> tuple[int, float]:
        where, late = self._long(a)
        av = _points(a[:MAX_PREFIX])
        if len(self.rank) > ROWS:
            return self._best_likely(a, av, where, late, c, w)
        cells = self._kept_cells(where >= 0)
        if cells is None:
            parts = [self._matched(a, where, late, slice(k, k + ROWS)) for k in range(0, len(self.rank), ROWS)]
            m, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            m, t = cells.matched(where)
            if c is None and not late:  # one name of a cell, of the lowest rank, stands for it
                at = cells.first
                jw = _jw(m[cells.of], t[cells.of], len(a), self.lens[at], self._prefix(av, at))
                got = best_of(np.clip((1.0 - w) * jw, 0.0, 1.0), self.rank[at])
                return (int(at[got[0]]), got[1]) if got[0] >= 0 else got
            of = cells.of[cells.cell]
            m, t = m[of], t[of]
            if late:
                missing = np.append(where < 0, False)  # the last one for the padding
                missing &= np.append(np.isin(self.kinds // self.deep, np.searchsorted(self.chars, [ord(ch) for ch in late])), False)
                rows = np.flatnonzero(missing[self.items].any(axis=1))
                m[rows], t[rows] = self._matched(a, where, late, rows)
        jw = _jw(m, t, len(a), self.lens, self._prefix(av, slice(None)))
        return best_of(np.clip((1.0 - w) * jw if c is None else w * c + (1.0 - w) * jw, 0.0, 1.0), self.rank)

    def _best_likely(self, a: str, av: np.ndarray, where: np.ndarray, late: set, c, w: float) -> tuple[int, float]:
        """Among many names: those of the highest bound first, then only those whose bound reaches the best score."""
        present = where >= 0
        if late:
            present |= np.isin(self.kinds // self.deep, np.searchsorted(self.chars, [ord(ch) for ch in late]))
        mine = _bits(np.flatnonzero(present).reshape(1, -1), len(self.bits))
        shared = self.excess.astype(np.int64)
        for of_text, word in zip(mine, self.bits, strict=True):
            shared += np.bitwise_count(word & of_text[0])
        jw = _jw(np.minimum(shared, self.lens), 0, len(a), self.lens, lambda at: self._prefix(av, at))
        bounds = (np.clip((1.0 - w) * jw if c is None else w * c + (1.0 - w) * jw, 0.0, 1.0)) + SLACK
        bounds = np.where(np.isnan(bounds), -np.inf, bounds)
        likely = np.argpartition(-bounds, ROWS)[:ROWS]
        best = self._best_of_rows(a, av, where, late, c, w, likely)
        rest = bounds >= best[1] if best[0] >= 0 else bounds > -np.inf
        rest[likely] = False
        rest = np.flatnonzero(rest)
        for k in range(0, len(rest), ROWS):
            rows = rest[k:k + ROWS]
            if best[0] >= 0:
                rows = rows[bounds[rows] >= best[1]]
            got = self._best_of_rows(a, av, where, late, c, w, rows) if len(rows) else (-1, 0.0)
            if got[0] >= 0 and (best[0] < 0 or got[1] > best[1] or (got[1] == best[1] and self.rank[got[0]] < self.rank[best[0]])):
                best = got
        return best

    def _best_of_rows(self, a: str, av: np.ndarray, where: np.ndarray, late: set, c, w: float, rows: np.ndarray) -> tuple[int, float]:
        m, t = self._matched(a, where, late, rows)
        jw = _jw(m, t, len(a), self.lens[rows], lambda at: self._prefix(av, rows[at]))
        p, s = best_of(np.clip((1.0 - w) * jw if c is None else w * c[rows] + (1.0 - w) * jw, 0.0, 1.0), self.rank[rows])
        return (int(rows[p]), s) if p >= 0 else (p, s)

    def _matched(self, a: str, where: np.ndarray, late: set, rows) -> tuple[np.ndarray, np.ndarray]:
        """Matches and half transpositions of the names ``rows``, those included that get a match of a ``late`` character from places
        of the text whose windows no longer reach their beginnings."""
        mat = self.mat[rows]
        if not late:
            order, by_order = _ordered(where, self.chars[self.kinds // self.deep])
            order = order[self.items[rows]]
            hit = order < len(by_order) - 1
            m = _count(hit)
            part = np.flatnonzero(m < self.lens[rows])
            if len(part):  # the matched characters to the left
                mat = mat.copy()
                left = np.sort(np.where(hit[part], np.arange(mat.shape[1], dtype=np.int32), np.int32(mat.shape[1])), axis=1)
                mat[part] = np.take_along_axis(np.append(mat[part], np.full((len(part), 1), -1, mat.dtype), axis=1), left, axis=1)
            return m, _half_moved(order, by_order, mat)
        place = np.append(np.where(where < 0, _NEVER, where), _NEVER)[self.items[rows]]
        window = len(a) // 2 - 1
        for i in range(window + 1, min(len(a), window + self.width)):
            if a[i] in late:
                free = (mat == ord(a[i])) & (place == _NEVER)
                free[:, :i - window] = False
                r = np.flatnonzero(free.any(axis=1))
                place[r, free[r].argmax(axis=1)] = i
        return (place < _NEVER).sum(axis=1), _half_transpositions(place, mat)

    def _prefix(self, av: np.ndarray, rows) -> np.ndarray:
        p = min(len(av), self.begin.shape[1])
        return np.cumprod(self.begin[rows, :p] == av[None, :p], axis=1).sum(axis=1)

    # ------------------------------------------------------------------ short texts, or windows that matter

    def _best_grouped(self, texts: list[str], cos: Cosines | None, on: np.ndarray, w: float, top: np.ndarray) -> list[tuple[int, float]]:
        """``on``: the rows of ``texts`` in ``cos``; ``top``: the score that a name must reach, raised to the best found."""
        best = np.full(len(texts), -1, dtype=np.int64)
        longest = max(map(len, texts))
        def batches(of, bounds):
            step = max(1, min(TEXTS, BOUNDS // bounds, CELLS // max(longest, self.width)))
            for lo in range(0, len(of), step):
                part = of[lo:lo + step]
                yield part, _Texts(self, [texts[i] for i in part]), None if cos is None else cos.rows(on[part])

        rest = np.arange(len(texts))
        if cos is None or cos.longest is not None:
            left = []
            for part, batch, c in batches(rest, len(self.runs)):
                t, b = top[part], best[part]
                left.append(part[self._best_by_runs(batch, c, w, t, b)])
                top[part], best[part] = t, b
            rest = np.concatenate(left)
        for part, batch, c in batches(rest, len(self.starts)):
            t, b = top[part], best[part]
            self._best_of_batch(batch, c, w, t, b)
            top[part], best[part] = t, b
        return [(int(p), float(s)) if p >= 0 else (-1, float("nan")) for p, s in zip(best, top, strict=True)]

    def _best_by_runs(self, batch: _Texts, cos: Dots | None, w: float, top: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Looks only at groups of runs whose bound, with the largest cosine that the vectors' lengths allow, reaches ``top``. Returns the
        texts for which these have too many names: not all of them are looked at."""
        cap = None if cos is None else Caps(cos)
        each = np.arange(len(top))[:, None]
        around = min(AROUND, len(self.rank))
        at = np.clip(np.array([bisect_left(self.spellings, a) for a in batch.texts]) - AROUND // 2, 0, len(self.rank) - around)
        rows = self.spelled[at[:, None] + np.arange(around)]
        self._compare(batch, rows.reshape(-1), np.repeat(np.arange(len(top)), around), cos, w, top, best)
        jw = _upper(batch.shared(self.run_bits, self.run_excess), batch.lens[:, None], self.run_shortest, self.run_longest,
                    batch.prefix(self.begins)[:, self.begin_id[self.starts[self.runs]]])
        bounds = _blended(jw, None if cap is None else cap.at(each, None), w)
        k = min(FIRST_RUNS, bounds.shape[1])
        some = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
        ok = bounds[each, some] >= top[:, None]
        text, groups, ub = self._groups_of(batch, np.broadcast_to(each, some.shape)[ok], some[ok], cap, w, top)
        bounds[each, some] = -np.inf
        # the likeliest names first: they set the score that others must reach
        order = np.lexsort((-ub, text))
        text, groups, ub = text[order], groups[order], ub[order]
        first = _place(text) < FIRST_GROUPS
        found = self._bounds(batch, text[first], groups[first], cap, w, top)
        found = self._compare_best(batch, *found, cos, w, top, best, FIRST)
        text, groups, ub = text[~first], groups[~first], ub[~first]
        more = bounds >= top[:, None]
        size = more @ self.run_size
        many = np.zeros(len(top), bool) if cos is None else size * SHARE > len(self.starts)
        more[many] = False
        size = np.cumsum(np.where(many, 0, size))
        lo = 0
        while lo < len(top):  # texts whose runs have a bounded number of groups in all, one at least
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            t, runs = np.nonzero(more[lo:hi])
            got = self._groups_of(batch, t + lo, runs, cap, w, top)
            mine = (text >= lo) & (text < hi) & ~many[text] & (ub >= top[text])
            t, g = np.concatenate([got[0], text[mine]]), np.concatenate([got[1], groups[mine]])
            mine = (found[1] >= lo) & (found[1] < hi) & ~many[found[1]]
            left = [x[mine] for x in found]
            order = np.argsort(t, kind="stable")
            for at in range(0, max(1, len(t)), PAIRS_AT_ONCE // GROUP):
                now = order[at:at + PAIRS_AT_ONCE // GROUP]
                left = [np.concatenate(x) for x in zip(left, self._bounds(batch, t[now], g[now], cap, w, top), strict=True)]
                several = NEXT
                while len(left[0]):
                    left = self._compare_best(batch, *left, cos, w, top, best, several)
                    several *= 4
            lo = hi
        return np.flatnonzero(many)

    def _groups_of(self, batch: _Texts, text: np.ndarray, runs: np.ndarray, cap: Caps | None, w: float, top: np.ndarray):
        """(text, group, upper bound) for the groups of pairs of ``text`` and ``runs`` that can reach ``top``."""
        n = self.run_size[runs]
        text = np.repeat(text, n)
        groups = np.arange(len(text)) + np.repeat(self.runs[runs] - np.cumsum(n) + n, n)
        m = self.group_excess[groups]
        for word, of_text in zip(self.group_bits, batch.bits, strict=True):
            m += np.bitwise_count(word[groups] & of_text[text])
        begin = batch.prefix(self.begins)[text, self.begin_id[self.starts[groups]]]
        ub = _blended(_upper(m, batch.lens[text], self.shortest[groups], self.longest[groups], begin), None if cap is None else cap.at(text, None), w)
        ok = ub >= top[text]
        return text[ok], groups[ok], ub[ok]

    def _best_of_batch(self, batch: _Texts, cos: Cosines | None, w: float, top: np.ndarray, best: np.ndarray) -> None:
        bounds = self._group_bounds(batch, cos, w)
        # the likeliest names first: they set the score that others must reach
        g = bounds.shape[1]
        some = np.argpartition(-bounds, FIRST_GROUPS - 1, axis=1)[:, :FIRST_GROUPS] if g > FIRST_GROUPS else np.broadcast_to(np.arange(g), bounds.shape)
        each = np.arange(len(top))[:, None]
        ok = bounds[each, some] >= top[:, None]
        rows, text, ub = self._bounds(batch, np.broadcast_to(each, some.shape)[ok], some[ok], cos, w, top)
        bounds[each, some] = -np.inf
        rows, text, ub = self._compare_best(batch, rows, text, ub, cos, w, top, best, FIRST)
        more = bounds >= top[:, None]
        size = np.cumsum(more @ (self.stops - self.starts))
        lo = 0
        while lo < len(top):  # texts whose groups have a bounded number of names in all, one at least
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
            t, groups = np.nonzero(more[lo:hi])
            got = self._bounds(batch, t + lo, groups, cos, w, top)
            mine = (text >= lo) & (text < hi)
            left = [np.concatenate([x[mine], y]) for x, y in zip((rows, text, ub), got, strict=True)]
            several = NEXT
            while len(left[0]):
                left = self._compare_best(batch, *left, cos, w, top, best, several)
                several *= 4
            lo = hi

    def _group_bounds(self, batch: _Texts, cos: Cosines | None, w: float) -> np.ndarray:
        """An upper bound of the score of every name in a group (columns) for each text; -inf where all are NaN."""
        jw = _upper(batch.shared(self.group_bits, self.group_excess), batch.lens[:, None], self.shortest, self.longest,
                    batch.prefix(self.begins)[:, self.begin_id[self.starts]])
        return _blended(jw, None if cos is None else cos.groups(self.starts), w)

    def _bounds(self, batch: _Texts, text: np.ndarray, groups: np.ndarray, cos: Cosines | None, w: float, top: np.ndarray):
        """The rows of ``groups`` that can reach the score ``top``, the ``text`` that each is for, and an upper bound of the score of each pair."""
        if not len(groups):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        rows, stop = self.starts[groups][:, None] + np.arange(self.largest)[None, :], self.stops[groups][:, None]
        inside = rows < stop
        rows = np.minimum(rows, stop - 1)
        m = self.excess[rows]
        for word, of_text in zip(self.bits, batch.bits, strict=True):
            m += np.bitwise_count(word[rows] & of_text[text][:, None])
        lens = self.lengths[rows]
        begin = batch.prefix(self.begins)[text, self.begin_id[rows[:, 0]]]  # a group's names begin alike
        ub = _blended(_upper(m, batch.lens[text][:, None], lens, lens, begin[:, None]), None if cos is None else cos.at(text[:, None], rows), w)
        at, place = np.nonzero(inside & (ub >= top[text][:, None]))
        return rows[at, place], text[at], ub[at, place]

    def _compare_best(self, batch: _Texts, rows, text, ub, cos, w: float, top: np.ndarray, best: np.ndarray, several: int):
        """Compares the ``several`` pairs of the highest bound of each text; returns the others that can still reach its score."""
        ok = ub >= top[text]
        rows, text, ub = rows[ok], text[ok], ub[ok]
        if not len(rows):
            return rows, text, ub
        order = np.lexsort((-ub, text))
        rows, text, ub = rows[order], text[order], ub[order]
        now = _place(text) < several
        self._compare(batch, rows[now], text[now], cos, w, top, best)
        later = ~now
        later[later] = ub[later] >= top[text[later]]
        return rows[later], text[later], ub[later]

    def _compare(self, batch: _Texts, rows: np.ndarray, text: np.ndarray, cos, w: float, top: np.ndarray, best: np.ndarray) -> None:
        """The exact scores of pairs of ``rows`` and ``text`` into ``top`` and ``best``."""
        parts = [slice(k, k + PAIRS) for k in range(0, len(rows), PAIRS)]
        jw = np.concatenate([_jaro_winkler_rows(batch.mat[text[k]], batch.lens[text[k]], self.mat[rows[k]], self.lens[rows[k]]) for k in parts])
        s = np.clip((1.0 - w) * jw if cos is None else w * cos.exact(text, rows) + (1.0 - w) * jw, 0.0, 1.0)
        ok = np.flatnonzero(np.isfinite(s))
        ok = ok[np.lexsort((self.rank[rows[ok]], -s[ok], text[ok]))]
        ok = ok[np.append(True, text[ok[1:]] != text[ok[:-1]])] if len(ok) else ok  # the best of each text
        t, r, s = text[ok], rows[ok], s[ok]
        won = (s > top[t]) | ((s == top[t]) & ((best[t] < 0) | (self.rank[r] < self.rank[best[t]])))
        top[t[won]], best[t[won]] = s[won], r[won]


def _upper(m, la, shortest, longest, prefix) -> np.ndarray:
    """An upper bound of Jaro-Winkler (float32, room for rounding in ``SLACK``) from at most ``m`` shared characters and the lengths."""
    f = np.float32
    m, la = m.astype(f), la.astype(f)
    length = shortest if shortest is longest else np.minimum(np.maximum(m, shortest), longest)  # where m / |a| + m / |b| is largest for m = min(shared, |b|)
    length = np.maximum(length, f(1.0))
    np.minimum(m, length, out=m)
    np.minimum(m, la, out=m)
    sim = m / length
    m /= la
    sim += m
    sim += f(1.0)
    sim *= f(1.0 / 3.0)
    boost = f(1.0) - sim
    boost *= prefix.astype(f) * f(PREFIX_WEIGHT)
    boost *= sim > f(BOOST_GATE - SLACK)
    sim += boost
    return sim


def _blended(jw: np.ndarray, cos: np.ndarray | None, w: float) -> np.ndarray:
    out = np.float32(1.0 - w) * jw
    if cos is not None:
        out += w * cos
    np.maximum(out, np.float32(0.0), out=out)  # keeps NaN
    out += np.float32(SLACK)
    if cos is not None:
        out[np.isnan(out)] = -np.inf
    return out


def _place(text: np.ndarray) -> np.ndarray:
    """The place of each among its equals, which follow each other."""
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])[:len(text)])
    return np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))


class Cosines:
    """(cosine + 1) / 2 of texts (rows) and names, a number for every pair; 0 where a text or name has no vector."""

    #: the largest norm of the names' vectors, if numbers are moderate
    longest: float | None = None

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def rows(self, on: np.ndarray) -> Cosines:
        return Cosines(self.matrix[on])

    def row(self, i: int) -> np.ndarray:
        return self.matrix[i]

    def groups(self, starts: np.ndarray) -> np.ndarray:
        """The highest of each group of names, or more."""
        return np.fmax.reduceat(self.matrix, starts, axis=1)

    def at(self, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of pairs, or more."""
        return self.matrix[text, rows]

    def exact(self, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.matrix[text, rows]


class Dots(Cosines):
    """The same from float32 products, raised by what rounding can hide, and in double precision for the pairs asked for only.
    ``has`` tells which texts and which names have a vector; all numbers must be finite and moderate (``fits``)."""

    def __init__(self, q: np.ndarray, qhas: np.ndarray, mat: np.ndarray, mhas: np.ndarray, longest: float):
        self.q, self.qhas, self.mat, self.mhas = q, qhas, mat, mhas
        self.longest = longest
        self.dots = None

    @staticmethod
    def fits(q: np.ndarray, longest: float) -> bool:
        """``longest``: the largest norm of the names' vectors."""
        return bool(np.isfinite(longest) and np.isfinite(q).all() and longest * np.sqrt((q ** 2).sum(axis=1)).max(initial=0.0) < 1e6)

    def rows(self, on: np.ndarray) -> Dots:
        return Dots(self.q[on], self.qhas[on], self.mat, self.mhas, self.longest)

    def row(self, i: int) -> np.ndarray:
        return self.exact(np.full(len(self.mat), i), np.arange(len(self.mat)))

    def _products(self) -> np.ndarray:
        if self.dots is None:
            self.dots = self.q.astype(np.float32) @ self.mat.T
            self.dots[:, ~self.mhas] = -1.0
            self.slack = ROUNDING * self.q.shape[1] * self.longest * np.sqrt((self.q ** 2).sum(axis=1))
        return self.dots

    def _raised(self, dots: np.ndarray, text) -> np.ndarray:
        return np.where(self.qhas[text], (dots + 1.0) / 2.0 + self.slack[text], 0.0)

    def groups(self, starts: np.ndarray) -> np.ndarray:
        return self._raised(np.maximum.reduceat(self._products(), starts, axis=1), np.arange(len(self.q))[:, None])

    def at(self, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self._raised(self._products()[text, rows], text)

    def exact(self, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        ok = np.flatnonzero(self.qhas[text] & self.mhas[rows])
        for k in range(0, len(ok), PAIRS):
            at = ok[k:k + PAIRS]
            out[at] = ((self.q[text[at]] * self.mat[rows[at]].astype(np.float64)).sum(axis=1) + 1.0) / 2.0
        return out


class Caps:
    """What no cosine of a text exceeds, by the vectors' lengths."""

    def __init__(self, dots: Dots):
        self.most = np.where(dots.qhas, (1.0 + np.sqrt((dots.q ** 2).sum(axis=1)) * dots.longest * (1.0 + 1e-9)) / 2.0, 0.0)

    def at(self, text: np.ndarray, rows) -> np.ndarray:
        return self.most[text]


class _Texts:
    """A batch of texts as the index sees them: characters, and which of its items (character, occurrence) each has, as bits."""

    def __init__(self, index: NameIndex, texts: list[str]):
        self.texts = texts
        self.mat, self.lens = encode_names(texts)
        chars = np.sort(self.mat, axis=1)
        at = np.minimum(np.searchsorted(index.chars, chars), max(0, len(index.chars) - 1))
        occurrence = _occurrences(chars)
        ok = (chars >= 0) & (occurrence < index.deep)
        ok &= index.chars[at] == chars if len(index.chars) else False
        code = at * index.deep + occurrence
        item = np.minimum(np.searchsorted(index.kinds, code), max(0, len(index.kinds) - 1))
        ok &= index.kinds[item] == code if len(index.kinds) else False
        self.bits = _bits(np.where(ok, item, -1), len(index.bits))
        p = min(self.mat.shape[1], index.begin.shape[1])
        self.begin = np.full((len(texts), index.begin.shape[1]), -2, dtype=np.int32)  # no name's character nor its padding
        self.begin[:, :p] = np.where(self.mat[:, :p] < 0, -2, self.mat[:, :p])
        self._prefix = None

    def shared(self, bits: np.ndarray, excess: np.ndarray) -> np.ndarray:
        """At most how many characters each text shares with each of ``bits`` (a row per word of the names' bits)."""
        out = np.broadcast_to(excess.astype(np.int16)[None, :], (len(self.lens), len(excess))).copy()
        for mine, word in zip(self.bits, bits, strict=True):
            out += np.bitwise_count(mine[:, None] & word[None, :])
        return out

    def prefix(self, begins: np.ndarray) -> np.ndarray:
        """The common beginning of each text and each of ``begins``."""
        if self._prefix is None:
            self._prefix = np.cumprod(self.begin[:, None, :] == begins[None, :, :], axis=2, dtype=np.int8).sum(axis=2, dtype=np.int8)
        return self._prefix


def _occurrences(ordered: np.ndarray) -> np.ndarray:
    """Which occurrence of its character (0: the first) each place of rows of sorted characters is."""
    place = np.broadcast_to(np.arange(ordered.shape[1]), ordered.shape)
    new = np.ones(ordered.shape, dtype=bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    return place - np.maximum.accumulate(np.where(new, place, 0), axis=1)


def _bits(items: np.ndarray, words: int) -> np.ndarray:
    """Rows of items (-1: none) as bits, (words x rows): an item is a bit, beyond ``64 * words`` of them several share one."""
    out = np.zeros((words, len(items)), dtype=np.uint64)
    for column in items.T:
        at = np.flatnonzero(column >= 0)
        bit = column[at] % (64 * words)
        out[bit >> 6, at] |= np.uint64(1) << (bit & 63).astype(np.uint64)
    return out


class _Cells:
    """Names by the sequence of their items that a text has (``of`` a row of ``items``), their length and their beginning: names of one
    cell have the same Jaro-Winkler to every such text, the ``first`` of them is that of the lowest rank."""

    def __init__(self, index: NameIndex, present: np.ndarray):
        n, width = index.items.shape
        has = (index.items >= 0) & present[index.items]
        # matched items to the left, in the order of the name
        order = np.argsort(~has, axis=1, kind="stable")
        kept = np.where(np.take_along_axis(has, order, axis=1), np.take_along_axis(index.items, order, axis=1), -1).astype(np.int32)
        kept = kept[:, :max(1, int(has.sum(axis=1).max(initial=0)))]
        pairs = np.full((n, -(-kept.shape[1] // 2) * 2), -1, dtype=np.int32)  # two items a sort key
        pairs[:, :kept.shape[1]] = kept
        keys = pairs.view(np.int64)
        by = np.lexsort(keys.T[::-1])
        new = np.ones(n, dtype=bool)
        new[1:] = (keys[by[1:]] != keys[by[:-1]]).any(axis=1)
        of = np.empty(n, dtype=np.int64)
        of[by] = np.cumsum(new) - 1
        self.items = kept[by[new]]
        by = np.lexsort((index.rank, index.begin_id, index.lens, of))
        new = np.ones(n, dtype=bool)
        new[1:] = (np.diff(of[by]) != 0) | (np.diff(index.lens[by]) != 0) | (np.diff(index.begin_id[by]) != 0)
        self.first = by[new]
        self.of = of[self.first]
        self.cell = np.empty(n, dtype=np.int64)
        self.cell[by] = np.cumsum(new) - 1
        self.of_kind = index.kinds // index.deep
        self.char = np.where(self.items >= 0, self.of_kind[self.items], -1)
        self.m = (self.items >= 0).sum(axis=1)
        self.size = self.items.size * 2 + n

    def matched(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches, and half the places at which the text's order of the matched characters is another than the name's."""
        order, by_order = _ordered(where, self.of_kind)
        return self.m, _half_moved(order[self.items], by_order, self.char)

