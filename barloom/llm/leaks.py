"""Evaluation texts leaking into training text.

``leaked_passages`` finds every page that holds a passage of a held-out item,
whole or in part, under scan faults: broken and misread words, columns read
across each other, adverts in between, a share of words changed.

Method: strings of ``m`` letters at every word start of every item are searched
in the letters of all pages by Wu-Manber multi-pattern search (shift table,
suffix-hash buckets, direct comparison; ``wumanber.py``). Blanks, case,
accents, punctuation and line ends don't count, so broken and joined words
match. Occurrences on one diagonal
are merged to runs and valued by the information of their words. A page and
item of which a chain of runs, in the order of both, carries enough are looked
at around all their runs, wherever these stand on the page. If strings of ``k``
letters, again in the order of both, cover enough of ``min_words`` words, the
page's letters around them are aligned letter by letter with the item: whole
lines of the page may be skipped, and lines without any such string are left
out, so foreign columns and adverts between the passage's lines cost little,
however long they are. The pair counts if a stretch of
``min_words`` words or more of the item stands there with at most
``max_changed`` of them changed, dropped or added; a word with a third of its
letters misread is unchanged.

Scale: the held-out set is the query; its size is a checked bound
(``max_item_letters``; beyond it items are searched in several passes of
bounded size). Pages stream once through ``mapInPandas``, nothing is shuffled
but the found pairs. Words weigh by their frequency in the whole set, and one
text given by several items is searched once. Texts longer than ``stretch`` are
searched in overlapping stretches by the same code.

Defined results: null and blank texts match nothing; items of fewer words than
``min_words`` can't be found; repeated pages each give their pairs, repeated
item ids act as one item with several texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.wumanber import Letters, WuManber, packed
from barloom.session import spread, written


@dataclass(frozen=True)
class LeakParams:
    m: int = 12
    block: int = 6
    bits: int = 22
    min_information: float = 28.0  # nats of a pair's chained runs; a passage of 20 words carries over 100 before faults
    k: int = 6  # letters of the strings that cover an item before it is aligned
    min_cover: float = 0.6  # of the letters of some ``min_words`` words of the item
    beyond: int = 10  # words of the item to both sides of such words that are aligned
    least_run: float = 8.0  # nats of a run that is kept; chance agreement of one word carries about as many
    least_text: int = 24_000  # words
    side_run: float = 20.0  # nats of a run that counts wherever it stands on the page, once a chain carries ``min_information``
    seed_reach: int = 1_500  # letters of a page within which runs support each other towards ``min_information``
    max_item_gap: int = 60
    min_words: int = 20
    max_changed: float = 1 / 6  # of a passage's words, changed, dropped or added
    match: int = 3  # of the alignment: a letter that stands
    miss: int = 2  # a letter misread, missing or added
    jump: int = 6  # lines skipped
    least_score: int = 70  # of an alignment worth judging; seventeen words of three letters carry 150 before faults
    word_letters: float = 6.0  # of an added word
    reach: int = 22  # words of the item to both sides of a run in which a passage of ``min_words`` is looked for
    page_reach: int = 500  # letters of the page between runs aligned at once
    margin: int = 250  # letters of the page on both sides of matching strings that are aligned
    page_letters: int = 3_000  # longer ranges are aligned in pieces of twice this, overlapping by half
    item_letters: int = 1_000
    together: int = 16  # alignments at once
    max_item_letters: int = 16_000_000  # of the query set in one pass; sent to the workers, so this is its bound
    batch_chars: int = 1_500_000
    stretch: int = 1_000_000
    overlap: int = 20_000


HASHED = 14


def _hashes(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.int64(0x9E3779B1)) >> np.int64(16)) & np.int64((1 << HASHED) - 1)


class Items:
    """The held-out set prepared for search and check."""

    def __init__(self, texts: list[str | None], p: LeakParams, counts: dict[bytes, int] | None = None, total: int = 0):
        """``counts``, ``total``: words of the whole held-out set, where the texts are a part of it."""
        self.p = p
        self._sorted: dict[int, tuple[np.ndarray, ...]] = {}
        L = self.letters = Letters(texts)
        starts = starts_all = np.flatnonzero(np.r_[True, L.word[1:] != L.word[:-1]]) if len(L.code) else np.zeros(0, np.int64)
        self.starts = starts_all
        self.grams = packed(L.code, np.arange(max(0, len(L.code) - p.k + 1)), p.k)
        of = L.text_of(starts)
        fits = starts + p.m <= L.start[of + 1]
        starts, of = starts[fits], of[fits]
        values = packed(L.code, starts, p.m)
        self.finder = WuManber(values, p.m, p.block, p.bits)
        order = np.argsort(values, kind="stable")
        self.values, self.at, self.of = values[order], (starts - L.start[of])[order], of[order]
        # Information of each letter: that of its word among all words of the items, spread over the word.
        ends = np.r_[starts_all[1:], len(L.code)] if len(starts_all) else starts_all
        words = L.words()
        count = counts or Counter(words)
        # A small set counts as part of a longer text, so that a word of it isn't taken for a common one.
        each = np.array([-np.log(count[w] / max(total or len(words), p.least_text)) / len(w) for w in words])
        self.information = np.r_[0.0, np.cumsum(np.repeat(each, ends - starts_all))] if words else np.zeros(1)

    def sorted_grams(self, item: int) -> tuple[np.ndarray, ...]:
        """Strings of ``k`` letters of an item in their order, their places, and the hashes that occur."""
        if item not in self._sorted:
            a, b = self.letters.start[item : item + 2]
            own = self.grams[a : max(a, b - self.p.k + 1)]
            order = np.argsort(own, kind="stable")
            there = np.zeros(1 << HASHED, bool)
            there[_hashes(own)] = True
            self._sorted[item] = own[order], order, there
        return self._sorted[item]

    def seeds(self, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence for every place of the pattern in the items: page place, item, item place."""
        lo, hi = np.searchsorted(self.values, value, "left"), np.searchsorted(self.values, value, "right")
        count = hi - lo
        row = np.repeat(np.arange(len(place)), count)
        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return place[row], self.of[pick], self.at[pick]


def _runs(letters: Letters, j: np.ndarray, item: np.ndarray, i: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Seeds (by page place) one after the other on one diagonal, merged: pair, page place, item place, information beyond one word."""
    p = items.p
    key = item.astype(np.int64) << 40 | (i - j + (1 << 39))
    o = np.argsort(key, kind="stable")
    key, j, i, item = key[o], j[o], i[o], item[o]
    joined = (key[1:] == key[:-1]) & (j[1:] - j[:-1] <= p.m + 2)
    start = np.flatnonzero(np.r_[True, ~joined])
    last = np.r_[start[1:], len(j)] - 1
    j0, item = j[start], item[start]
    base = items.letters.start[item]
    a = base + i[start]
    doc = letters.text_of(j0)
    b = np.minimum(a + np.minimum(j[last] + p.m, letters.start[doc + 1]) - j0, items.letters.start[item + 1])
    worth = items.information[b] - items.information[a]
    good = (worth > p.least_run) & (b - a >= p.m)
    return (doc.astype(np.int64) << 32 | item)[good], j0[good], i[start][good], worth[good]


def _chained(pair: np.ndarray, j: np.ndarray, i: np.ndarray, worth: np.ndarray, p: LeakParams) -> np.ndarray:
    """For runs in the order of pair and page: the most information of a chain that ends with the run, in the order of both page and item, over all runs within ``seed_reach``."""
    best = worth.copy()
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    size = np.diff(np.r_[start, len(pair)])

    def add(t: np.ndarray | int, u: np.ndarray | slice) -> np.ndarray:
        dj, di = j[t] - j[u], i[t] - i[u]
        ok = (dj > 0) & (di > 0) & (dj <= p.seed_reach) & (di <= 4 * p.max_item_gap) & (dj >= di - 20) & (dj <= 3 * di + 500)
        return np.where(ok, best[u], 0.0)

    few = size <= 32
    order = np.flatnonzero(few)[np.argsort(-size[few], kind="stable")]
    s, z = start[order], size[order]
    for r in range(1, int(z[0]) if len(z) else 0):  # the r-th run of all pairs at once
        t = s[: np.searchsorted(-z, -r, side="left")] + r
        more = np.zeros(len(t))
        for back in range(1, r + 1):
            more = np.maximum(more, add(t, t - back))
        best[t] += more
    for a, n in zip(start[~few], size[~few]):
        first = a + np.searchsorted(j[a : a + n], j[a : a + n] - p.seed_reach)
        for t in range(a + 1, a + n):
            if first[t - a] < t:
                best[t] += add(t, slice(first[t - a], t)).max()
    return best


def _candidates(letters: Letters, j: np.ndarray, item: np.ndarray, i: np.ndarray, items: Items) -> np.ndarray:
    """Rows (doc, item, ranges of letters of both) around the runs of pairs of which a chain carries ``min_information``."""
    p = items.p
    none = np.zeros((0, 6), np.int64)
    if not len(j):
        return none
    pair, j, i, worth = _runs(letters, j, item, i, items)
    if not len(pair):
        return none
    o = np.lexsort((i, j, pair))
    pair, j, i, worth = pair[o], j[o], i[o], worth[o]
    core = _chained(pair, j, i, worth, p) >= p.min_information
    # Of a pair with such a chain all other sound runs count too, however far away on the page: lines between parts of a passage are no limit.
    good = core | (np.isin(pair, pair[core]) & (worth >= p.side_run))
    pair, j, i = pair[good], j[good], i[good]
    if not len(pair):
        return none
    # A passage's twenty words lie around its runs; runs near each other share a window.
    new = np.r_[True, (pair[1:] != pair[:-1]) | (j[1:] - j[:-1] > p.page_reach)]
    first = np.flatnonzero(new)
    doc, item = pair[first] >> 32, pair[first] & 0xFFFFFFFF
    lo, size = letters.start[doc], items.letters.start[item + 1] - items.letters.start[item]
    last = np.r_[first[1:], len(j)] - 1
    own, base = items.starts, items.letters.start[item]
    x = own[np.maximum(np.searchsorted(own, base + np.minimum.reduceat(i, first), "right") - 1 - p.reach, 0)] - base
    y = own[np.minimum(np.searchsorted(own, base + np.maximum.reduceat(i, first), "right") + p.reach, len(own) - 1)] - base
    x, y = np.maximum(x, 0), np.minimum(np.where(y + base == own[-1], size, y), size)
    wide = np.maximum(2 * (y - x), p.page_reach) // 2 + 150  # every second line may be foreign
    a, b = np.maximum(j[first] - lo - wide, 0), np.minimum(j[last] - lo + wide, letters.start[doc + 1] - lo)
    return np.stack([doc, item, a, b, x, y], 1)


def _paths(pages: list[np.ndarray], lines: list[np.ndarray], words: list[np.ndarray], wanted: list[np.ndarray], own: list[np.ndarray], p: LeakParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each page and item the best alignment of their letters: how many of the item's letters stand (1), are misread (2) or missing (0), and the page letters and words added after each."""
    many, n, w = len(pages), max(map(len, wanted)), max(map(len, pages))
    page, item = np.full((many, w), 200, np.uint8), np.full((many, n), 100, np.uint8)
    # Between the ends of lines a path may skip whole lines: foreign columns and adverts.
    ends = [np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) for x in lines]
    end = np.zeros((many, max(map(len, ends))), np.int64)
    for b in range(many):
        page[b, : len(pages[b])], item[b, : len(wanted[b])] = pages[b], wanted[b]
        end[b] = np.r_[ends[b], np.full(end.shape[1] - len(ends[b]), ends[b][-1])]
    row = np.arange(many)[:, None]
    like = np.empty((26, many, w), np.int16)
    for c in range(26):
        like[c] = np.where(page == c, p.match, -p.miss)
    like = np.r_[like, np.full((1, many, w), -p.miss, np.int16)]
    score = np.zeros((n + 1, many, w + 1), np.int16)
    work = np.empty((many, w + 1), np.int16)
    for i in range(n):
        old, now = score[i], score[i + 1]
        np.add(old[:, :-1], like[np.minimum(item[:, i], 26), row[:, 0]], out=now[:, 1:])
        np.subtract(old, p.miss, out=work)
        np.maximum(now, work, out=now)
        np.maximum(now, 0, out=now)
        for again in (False, True):  # letters may be added before and after a skip
            for k in (1, 2, 4, 8):  # up to 15 at a time
                np.subtract(now[:, :-k], p.miss * k, out=work[:, k:])
                np.maximum(now[:, k:], work[:, k:], out=now[:, k:])
            if not again:
                v = now[row, end]
                v[:, 1:] = np.maximum(v[:, 1:], np.maximum.accumulate(v, axis=1)[:, :-1] - p.jump)
                now[row, end] = v
    for b in range(many):
        h, x, y = score[:, b], page[b], item[b]
        state, added, more = np.zeros(len(wanted[b]), np.int8), np.zeros(len(wanted[b]) + 1, np.int64), np.zeros(len(wanted[b]) + 1, np.int64)
        i, c = last = divmod(int(h.argmax()), w + 1)
        seen = -1
        if h[i, c] >= p.least_score:
            at_end = set(ends[b].tolist())
            while i > 0 and h[i, c] > 0:
                v = int(h[i, c])
                if c and v == h[i - 1, c - 1] + (p.match if x[c - 1] == y[i - 1] else -p.miss):
                    state[i - 1] = 1 if x[c - 1] == y[i - 1] else 2
                    i, c = i - 1, c - 1
                elif v == h[i - 1, c] - p.miss:
                    i -= 1
                elif c and v == h[i, c - 1] - p.miss:
                    added[i] += 1
                    more[i] += words[b][c - 1] != seen
                    seen = words[b][c - 1]
                    c -= 1
                else:
                    before = ends[b][ends[b] < c] if c in at_end else ()
                    from_ = [e for e in before if h[i, e] - p.jump == v]
                    if not from_:
                        break
                    c = int(from_[-1])
            # A short word after a changed one at an end doesn't pay for it in the alignment.
            n_b, w_b = len(wanted[b]), len(pages[b])
            _beyond(state, y[:n_b], own[b], x[:w_b], *last)
            _beyond(state[::-1], y[:n_b][::-1], own[b][::-1], x[:w_b][::-1], n_b - i, w_b - c)
        yield state, added, more


def _beyond(state: np.ndarray, item: np.ndarray, word: np.ndarray, page: np.ndarray, i: int, c: int) -> None:
    """Marks the words after the end of a path that stand behind one changed or dropped word."""
    start = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)]
    k = int(np.searchsorted(start, i, "left"))
    if k and start[k] > i and k + 1 < len(start) and (state[start[k - 1] : i] == 1).sum() * 2 > start[k] - start[k - 1]:
        pass
    elif start[k] != i:
        k -= 1  # the path ends within a changed word
    if k + 2 >= len(start):
        return
    text = page.tobytes()
    for far in (2, 1):
        end = min(k + 1 + far, len(start) - 1)
        look = item[start[k + 1] : start[end]].tobytes()
        at = text.find(look, c, c + int(start[k + 1] - start[k]) + 12 + len(look))
        if len(look) > 1 and at >= 0:
            state[start[k + 1] : start[end]] = 1
            return


def _stretch(state: np.ndarray, added: np.ndarray, more: np.ndarray, word: np.ndarray, p: LeakParams) -> tuple[int, float]:
    """Words of the item's longest stretch that stands with at most ``max_changed`` of them changed, dropped or added, and the share that stands; 0 words if there is none of ``min_words``."""
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    size = np.diff(np.r_[start, len(word)])
    wrong = np.add.reduceat((state != 1).astype(np.int64), start)
    missing = np.add.reduceat((state == 0).astype(np.int64), start)
    last = start + size - 1
    inner = added[1:].copy()
    inner[last] = 0
    # Letters added at one place within a word are a word that was added before its last letters.
    most = np.maximum.reduceat(inner, start)
    spread_ = np.add.reduceat(inner, start) - most
    # Scan faults may take a third of a word's letters; of a word of one or two letters one, if its neighbours stand.
    same = wrong + spread_ <= size // 3
    beside = np.r_[False, same[:-1]] & np.r_[same[1:], False]
    same |= beside & (size < 3) & (wrong == 1) & (missing == 0)
    between = np.where(most > 2, most, 0) + added[1:][last]
    extra = np.where(same, np.minimum(np.ceil((between - 2) / p.word_letters).clip(0), np.add.reduceat(more[1:], start)), 0)
    extra = np.where(np.r_[same[1:], False], extra, 0)
    fault = np.r_[0.0, np.cumsum(~same + extra)]
    n = len(size)
    x, y = np.triu_indices(n + 1, p.min_words)
    # Words added after the stretch's last word don't count to it.
    faults = fault[y] - fault[x] - np.r_[0.0, extra][y]
    ok = faults <= p.max_changed * (y - x) + 1e-9
    if not ok.any():
        return 0, 0.0
    x, y = x[ok], y[ok]
    best = int((y - x).argmax())
    x, y = x[best], y[best]
    return int(y - x), float(same[x:y].mean())


@dataclass(frozen=True)
class _Task:
    """Letters of a page (places in the batch, ascending) to be aligned with letters ``x`` to ``y`` of an item."""

    doc: int
    item: int
    page: np.ndarray
    x: int
    y: int


def _tasks(rows: np.ndarray, L: Letters, p: LeakParams) -> Iterator[_Task]:
    """The windows of a pair end to end as one page: what lies between them has no run and would be skipped. Long ones go in pieces that overlap by half."""
    cut = lambda a, b, size: [(a, b)] if b - a <= 2 * size else [(k, min(k + 2 * size, b)) for k in range(a, b - size, size)]
    if not len(rows):
        return
    edge = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True]).tolist()
    for m, n in zip(edge, edge[1:]):
        d, it = int(rows[m, 0]), int(rows[m, 1])
        lo, at, parts = int(L.start[d]), 0, []
        for a, b in rows[m:n, 2:4].tolist():
            if b > max(a, at):
                parts.append(np.arange(lo + max(a, at), lo + b))
                at = b
        page = parts[0] if len(parts) == 1 else np.concatenate(parts)
        x, y = int(rows[m:n, 4].min()), int(rows[m:n, 5].max())
        yield from (_Task(d, it, page[u:v], *w) for u, v in cut(0, len(page), p.page_letters) for w in cut(x, y, p.item_letters))


def _dense(cover: np.ndarray, edge: np.ndarray, p: LeakParams) -> np.ndarray:
    """First words of those stretches of ``min_words`` words of which enough letters are covered."""
    total = np.zeros(len(cover) + 1, np.int64)
    np.cumsum(cover, out=total[1:])
    u, v = edge[: -p.min_words], edge[p.min_words :]
    return np.flatnonzero((total[v] - total[u]) >= p.min_cover * (v - u))


def _chain(i: list[int], j: list[int], n: list[int]) -> list[int]:
    """Segments (by ``j``; ``n`` strings each from item place ``i`` and page place ``j`` on) of the chain with most strings, in the order of both."""
    size = len(i)
    best, prev = list(n), [-1] * size
    ends = sorted(range(size), key=lambda t: j[t] + n[t])
    tops: list[int] = []  # last item places of chains that are worth more than all that end earlier
    who: list[int] = []
    done = 0
    for t in range(size):
        while done < size and j[ends[done]] + n[ends[done]] <= j[t]:
            u = ends[done]
            done += 1
            end = i[u] + n[u] - 1
            at = bisect_right(tops, end)
            if at and best[who[at - 1]] >= best[u]:
                continue
            last = at
            while last < len(tops) and best[who[last]] <= best[u]:
                last += 1
            tops[at:last], who[at:last] = [end], [u]
        at = bisect_left(tops, i[t])
        if at:
            prev[t] = who[at - 1]
            best[t] += best[prev[t]]
    t = max(range(size), key=best.__getitem__)
    out = []
    while t >= 0:
        out.append(t)
        t = prev[t]
    return out[::-1]


def _narrowed(task: _Task, grams: np.ndarray, hashes: np.ndarray, items: Items) -> _Task | None:
    """The task around the best chain of strings of ``k`` letters, or null if these cover too little of every ``min_words`` words of the item for an alignment to be worth it."""
    p, base = items.p, int(items.letters.start[task.item])
    s, x, y = items.starts, base + task.x, base + task.y
    edge = np.append(s[np.searchsorted(s, x) : np.searchsorted(s, y)], y) - x
    own, at, there = items.sorted_grams(task.item)
    if len(edge) <= p.min_words or not len(own):
        return None
    size_of_page = len(task.page)
    j = np.flatnonzero(there[hashes[task.page]])
    g = grams[task.page[j]]
    lo = np.searchsorted(own, g)
    lo[lo == len(own)] = 0
    same = own[lo] == g
    j, lo = j[same], lo[same]
    n = np.searchsorted(own, g[same], "right") - lo
    if len(j) and n.max() > 1:
        lo = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        j = np.repeat(j, n)
    i = at[lo] - task.x
    inside = (i >= 0) & (i + p.k <= task.y - task.x)
    i, j = i[inside], j[inside]
    size = task.y - task.x
    cover = lambda start, end: np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0
    dense = _dense(cover(i, i + p.k), edge, p)
    if not len(dense):
        return None
    inside = (i + p.k > edge[dense[0]]) & (i < edge[dense[-1] + p.min_words])
    i, j = i[inside], j[inside]
    # In order: matches on one diagonal are segments, and the best chain of segments counts.
    key = np.sort((i - j + (1 << 30)) << 32 | j)
    step = np.ones(len(key), bool)
    step[1:] = key[1:] - key[:-1] != 1
    first = np.flatnonzero(step)
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    j = key & 0xFFFFFFFF
    i = (key >> 32) - (1 << 30) + j
    o = np.argsort(j, kind="stable")
    i, j, n = i[o], j[o], n[o]
    c = np.array(_chain(i.tolist(), j.tolist(), n.tolist()))
    i, j, n = i[c], j[c], n[c]
    dense = _dense(cover(i, i + n + p.k - 1), edge, p)
    if not len(dense):
        return None
    lo, hi = edge[max(0, int(dense[0]) - p.beyond)], edge[min(len(edge) - 1, int(dense[-1]) + p.min_words + p.beyond)]
    here = (i + n + p.k > lo) & (i < hi)
    start, end = np.maximum(j[here] - p.margin, 0), np.minimum(j[here] + n[here] + p.k + p.margin, size_of_page)
    near = np.cumsum(np.bincount(start, minlength=size_of_page + 1) - np.bincount(end, minlength=size_of_page + 1))[: size_of_page] > 0
    return _Task(task.doc, task.item, task.page[near], task.x + int(lo), task.x + int(hi))


def find_in_texts(texts: list[str | None], items: Items) -> list[tuple[int, int, int, float]]:
    """Rows (text, item, words, share) of all found pairs."""
    p, own = items.p, items.letters
    L = Letters(texts)
    place, value = items.finder.search(L.code)
    grams = np.r_[packed(L.code, np.arange(max(0, len(L.code) - p.k + 1)), p.k), np.full(p.k - 1, -1)]
    hashes = _hashes(grams).astype(np.uint16)
    wide = _tasks(_candidates(L, *items.seeds(place, value), items), L, p)
    tasks = [t for w in wide if (t := _narrowed(w, grams, hashes, items)) is not None]
    tasks.sort(key=lambda t: ((t.y - t.x) // 64, len(t.page)))
    out: dict[tuple[int, int], tuple[int, float]] = {}
    while tasks:  # ranges of like length together
        wide = max(len(t.page) for t in tasks[-p.together :]) * (tasks[-1].y - tasks[-1].x)
        some = [tasks.pop() for _ in range(min(len(tasks), max(1, min(p.together, 20_000_000 // max(1, wide)))))]
        wanted = [slice(own.start[t.item] + t.x, own.start[t.item] + t.y) for t in some]
        paths = _paths([L.code[t.page] for t in some], [L.line[t.page] for t in some], [L.word[t.page] for t in some], [own.code[s] for s in wanted], [own.word[s] for s in wanted], p)
        for t, s, (state, added, more) in zip(some, wanted, paths):
            if state.any():
                words, share = _stretch(state, added, more, own.word[s], p)
                if words:
                    out[t.doc, t.item] = max(out.get((t.doc, t.item), (0, 0.0)), (words, share))
    return [(d, it, *v) for (d, it), v in sorted(out.items())]


_prepared: dict[tuple, Items] = {}


def _stretches(text: str, p: LeakParams) -> list[str]:
    if len(text) <= p.stretch:
        return [text]
    return [text[k : k + p.stretch] for k in range(0, len(text) - p.overlap, p.stretch - p.overlap)]


def _search(batches: Iterator[pd.DataFrame], ids: list[list[int]], texts: list[str], counts: dict[bytes, int] | None, total: int, config: dict) -> Iterator[pd.DataFrame]:
    """``ids``: of each text, the items that have it."""
    p = LeakParams(**config)
    key = (hash(tuple(texts)), p)
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Items(texts, p, counts, total)
    items = _prepared[key]

    def flush(docs: list, parts: list) -> pd.DataFrame:
        best: dict[tuple, tuple[int, float]] = {}
        for d, it, words, share in find_in_texts(parts, items):
            for item_id in ids[it]:
                pair = (docs[d], item_id)
                best[pair] = max(best.get(pair, (0, 0.0)), (words, share))
        return pd.DataFrame([(*k, *v) for k, v in best.items()], columns=["doc_id", "item_id", "words", "share"]).astype({"words": "int32", "share": "float64"})

    docs, parts, size = [], [], 0
    for pdf in batches:
        for d, text in zip(pdf["doc_id"], pdf["text"]):
            for part in _stretches(text or "", p):
                docs.append(d)
                parts.append(part)
                size += len(part)
                if size >= p.batch_chars:
                    yield flush(docs, parts)
                    docs, parts, size = [], [], 0
    if parts:
        yield flush(docs, parts)


def _word_counts(items: DataFrame) -> DataFrame:
    """``word`` (its letters' codes), ``n`` over all texts, and the passes that hold it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, texts in pdf.groupby("_pass")["text"]:
                found = Counter(Letters(list(texts)).words())
                yield pd.DataFrame({"word": list(found), "n": list(found.values()), "_pass": k})

    each = items.mapInPandas(count, "word binary, n bigint, _pass int")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.collect_set("_pass").alias("_passes"))


def leaked_passages(documents: DataFrame, eval_items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """Columns ``doc_id``, ``item_id``, ``words`` (of the item, covered on the page), ``share`` (of that stretch of the item)."""
    own = eval_items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // params.max_item_letters))
    # A pass takes a block of the query set, of bounded size, against all pages; one text is in one block, whoever has it.
    own = own.withColumn("_pass", F.pmod(F.xxhash64("text"), F.lit(passes)).cast("int"))
    if passes > 1:
        own = written(own)
        known = written(_word_counts(own))
        total = int(known.agg(F.sum("n")).first()[0] or 0)
    pages = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    config = asdict(params)
    out = None
    for k in range(passes):
        ids: dict[str, list[int]] = {}
        for r in own.where(F.col("_pass") == k).orderBy("text", "item_id").collect():
            ids.setdefault(r["text"], []).append(r["item_id"])
        # Words weigh by the whole set, however it is cut into passes.
        counts = {bytes(r["word"]): r["n"] for r in known.where(F.array_contains("_passes", k)).collect()} if passes > 1 else None
        given = (list(ids.values()), list(ids), counts, total if passes > 1 else 0, config)
        found = pages.mapInPandas(lambda it, given=given: _search(it, *given), "doc_id bigint, item_id bigint, words int, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "share")).alias("b")).select("doc_id", "item_id", "b.words", "b.share")
