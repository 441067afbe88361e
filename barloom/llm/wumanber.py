"""Wu-Manber search for many strings at once, over letters of many texts, on NumPy arrays.

Texts are letters only (codes 0 to 25). All patterns have ``m`` letters. Three
tables drive the search: SHIFT says for the last ``block`` letters under the
cursor how far every pattern's end is at least away, a bucket table lists the
patterns by the hash of their last block, and the packed pattern itself decides
by direct comparison. The corpus is cut into lanes whose cursors move together,
each by its own shift, so impossible positions are skipped in all lanes at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

_LETTER = np.full(256, 255, np.uint8)
for _k in range(26):
    _LETTER[ord("a") + _k] = _LETTER[ord("A") + _k] = _k
# Digits that scanners put for letters.
for _digit, _letter in {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g"}.items():
    _LETTER[ord(_digit)] = ord(_letter) - ord("a")
_NEWLINE = ord("\n")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def plain(text: str | None) -> bytes:
    """ASCII bytes of a text: accents dropped, one kind of line end."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return text.encode("ascii", "ignore").replace(b"\r\n", b"\n").replace(b"\r", b"\n")


class Letters:
    """Letters of several texts end to end: ``code``, ``text`` (index), ``line`` and ``word`` (running numbers over all texts)."""

    def __init__(self, texts: list[str | None]):
        parts = [plain(t) + b"\n" for t in texts]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        code = _LETTER[raw]
        keep = np.flatnonzero(code != 255)
        self.code = code[keep]
        size = np.array([len(p) for p in parts], np.int64)
        line = np.cumsum(raw == _NEWLINE, dtype=np.int32)
        blank = _BLANK[raw]
        word = np.cumsum(np.diff(blank.astype(np.int8), prepend=1) == -1, dtype=np.int32)
        self.line, self.word = line[keep], word[keep]
        ends = np.cumsum(size)
        self.start = np.searchsorted(keep, np.r_[0, ends])  # first letter of each text, and the end

    def words(self) -> list[bytes]:
        """Letters of each word."""
        at = np.flatnonzero(np.r_[True, self.word[1:] != self.word[:-1]]) if len(self.code) else np.zeros(0, np.int64)
        return [self.code[a:b].tobytes() for a, b in zip(at, np.r_[at[1:], len(self.code)])]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1


def packed(code: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """``length`` letters from each place as one number (5 bits a letter, 12 letters at most)."""
    out = np.zeros(len(at), np.int64)
    for k in range(length):
        out = (out << 5) | code[at + k]
    return out


class WuManber:
    def __init__(self, patterns: np.ndarray, m: int = 12, block: int = 5, bits: int = 20):
        """``patterns``: packed patterns of ``m`` letters, distinct."""
        self.m, self.block, self.bits = m, block, bits
        self.most = m - block + 1
        patterns = np.unique(patterns)
        letters = (patterns[:, None] >> (5 * np.arange(m - 1, -1, -1))) & 31
        shift = np.full(1 << bits, self.most, np.uint8)
        for end in range(block, m + 1):  # later ends last: the smaller shift wins
            value = np.zeros(len(patterns), np.int64)
            for k in range(end - block, end):
                value = (value << 5) | letters[:, k]
            h = self._hash(value)
            np.minimum.at(shift, h, np.uint8(m - end))
            if end == m:
                last = h
        self.shift = shift
        order = np.argsort(last, kind="stable")
        self.patterns = patterns[order]
        self.first = np.searchsorted(last[order], np.arange((1 << bits) + 1))

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return ((value * np.int64(0x9E3779B1)) >> np.int64(12)) & np.int64((1 << self.bits) - 1)

    def search(self, code: np.ndarray, lane: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """First letters and packed values of all occurrences in ``code``."""
        n = len(code)
        if n < self.m or not len(self.patterns):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = np.zeros(n, np.int64)
        for k in range(self.block):
            value[self.block - 1 :] |= code[self.block - 1 - k : n - k].astype(np.int64) << (5 * k)
        h = self._hash(value).astype(np.int32)
        shift = self.shift
        cursor = np.arange(self.m - 1, n, lane)
        stop = np.minimum(cursor + lane, n)
        hits = []
        while len(cursor):
            s = shift[h[cursor]]
            zero = s == 0
            if zero.any():
                hits.append(cursor[zero])
            cursor = cursor + np.maximum(s, 1)
            alive = cursor < stop
            if not alive.all():
                cursor, stop = cursor[alive], stop[alive]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(hits)
        lo, hi = self.first[h[end]], self.first[h[end] + 1]
        here = packed(code, end - self.m + 1, self.m)
        found = []
        step = lo.copy()
        live = step < hi
        while live.any():
            at = np.flatnonzero(live)
            same = self.patterns[step[at]] == here[at]
            found.append(at[same])
            step[at] += 1
            live[at] = ~same & (step[at] < hi[at])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        at = at[np.argsort(end[at], kind="stable")]
        return end[at] - self.m + 1, here[at]
