"""Periodic runs of words (Kolpakov and Kucherov), and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that no neighbouring word extends, of at least ``times``
periods and at least ``least`` words. For each document:

1. Words that occur fewer than ``times`` times between two such words can't lie
   in a run, as each word of a run comes back in every period. The document is
   cut at them, again and again while that removes anything. This is exact.
2. Each stretch that is left is factorised (Lempel-Ziv, with overlap) by a walk
   over its suffix automaton.
3. Runs that touch the border of two factors are found there by Main's
   algorithm: with longest common extensions (Z functions) of a window to the
   left and the factor on the right. A run that starts more than its period and
   the factor on the left before its last border would have made that factor
   longer, which bounds the window, and all windows together.
4. All other runs lie inside one factor, and are copied from the factor's
   earlier occurrence.

Time and memory are linear in a document's words; documents are independent, so
nothing is shuffled.

Nulls and edge cases: null, empty and blank texts have no words, no runs and an
empty collapsed text; repeated rows and ids are answered row by row; a null id
is never rewritten by the query; texts of one word repeated a million times are
two factors; other columns of the input are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A run has at least so many periods, and at least so many words.
TIMES, LEAST = 4, 6
#: Rounds of cutting at rare words; what is left then goes to the exact search in any case.
ROUNDS = 12

SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixAutomaton:
    """States with their longest length, suffix link and first end position; a state's first transition is kept in arrays, more of them in a dictionary."""

    def __init__(self, word: np.ndarray):
        self.size, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.letter, self.target = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for at, w in enumerate(word.tolist()):
            last = self._extend(last, w, at)

    def step(self, state: int, w: int) -> int:
        """The state behind w, or -1."""
        if self.letter[state] == w:
            return self.target[state]
        found = self.more.get(state)
        return found.get(w, -1) if found is not None else -1

    def _set(self, state: int, w: int, to: int) -> None:
        own = self.letter[state]
        if own == -1 or own == w:
            self.letter[state], self.target[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, size: int, link: int, end: int, letter: int, target: int) -> int:
        self.size.append(size)
        self.link.append(link)
        self.end.append(end)
        self.letter.append(letter)
        self.target.append(target)
        return len(self.size) - 1

    def _extend(self, last: int, w: int, at: int) -> int:
        size, link, step, put = self.size, self.link, self.step, self._set
        new = self._state(size[last] + 1, 0, at, -1, 0)
        p = last
        while p != -1 and (q := step(p, w)) == -1:
            put(p, w, new)
            p = link[p]
        if p == -1:
            return new
        if size[p] + 1 == size[q]:
            link[new] = q
            return new
        clone = self._state(size[p] + 1, link[q], self.end[q], self.letter[q], self.target[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p != -1 and step(p, w) == q:
            put(p, w, clone)
            p = link[p]
        link[q] = link[new] = clone
        return new


def factors(word: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, length, earlier begin or -1): a new word, or the longest string that also begins earlier."""
    auto, words = SuffixAutomaton(word), word.tolist()
    out, begin, n = [], 0, len(words)
    while begin < n:
        state, at, before = 0, begin, -1
        while at < n and (to := auto.step(state, words[at])) != -1 and auto.end[to] < at:
            state, before = to, auto.end[to]
            at += 1
        size = at - begin
        out.append((begin, max(size, 1), before - size + 1 if size else -1))
        begin += max(size, 1)
    return out


def _z(x: list[int]) -> list[int]:
    """Longest common prefix of x and each of its suffixes."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def _at_border(x: list[int], low: int, border: int, high: int, longest: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions of x[low:high] that touch the border, of periods up to longest."""
    left, right = x[low:border], x[border:high]
    n, m = len(left), len(right)
    ahead = _z(right)
    back = _z(left[::-1])
    over_left = _z(left[::-1] + [-1] + (left + right)[::-1])  # common suffixes of left and left + right[:k]
    over_right = _z(right + [-1] + left + right)  # common prefixes of right and suffixes of left + right
    for q in range(1, longest + 1):
        if q <= m:  # a whole period on the right
            before = over_left[n + 1 + m - q] if n else 0
            after = ahead[q] if q < m else 0
            if before + q + after >= times * q:
                yield border - before, border + q + after, q
        if q <= n:  # a whole period on the left
            after = min(over_right[m + 1 + n - q], m) if m else 0
            before = back[q] if q < n else 0
            if before + q + after >= times * q:
                yield border - q - before, border + after, q


def runs_of(word: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence of small integers, in order."""
    x, n = word.tolist(), len(word)
    period: dict[tuple[int, int], int] = {}
    starts: list[int] = []
    ends: dict[int, list[int]] = {}

    def add(start: int, end: int, q: int) -> None:
        known = period.get((start, end))
        if known is None:
            insort(starts, start) if start not in ends else None
            ends.setdefault(start, []).append(end)
        if known is None or q < known:
            period[start, end] = q

    parts = factors(word)
    for k in range(len(parts) + 1):
        border, size, earlier = parts[k] if k < len(parts) else (n, 0, -1)
        on_left = parts[k - 1][1] if k else 0
        longest = (on_left + size) // (times - 1)
        if longest:
            low = max(0, border - on_left - longest - 1)
            for start, end, q in _at_border(x, low, border, border + size, longest, times):
                if end - start >= least and (start == 0 or x[start - 1] != x[start - 1 + q]) and (end == n or x[end] != x[end - q]):
                    add(start, end, q)
        if earlier >= 0:
            at = bisect_right(starts, earlier)
            while at < len(starts) and starts[at] < earlier + size:
                for end in list(ends[starts[at]]):
                    if end < earlier + size:
                        add(starts[at] - earlier + border, end - earlier + border, period[starts[at], end])
                at += 1
    return sorted((s, e, q) for (s, e), q in period.items())


def _stretches(codes: np.ndarray, times: int, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches in which runs can lie."""
    at = np.arange(len(codes))
    piece = np.zeros(len(codes), np.int64)
    for _ in range(ROUNDS):
        if not len(at):
            return
        key = piece * (int(codes.max()) + 1) + codes[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[which] >= times
        kept = at[keep]
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (np.diff(kept) != 1) | (np.diff(piece[keep]) != 0)
        piece = np.cumsum(new) - 1
        long = np.bincount(piece)[piece] >= least if len(kept) else np.zeros(0, bool)
        if len(kept) == len(at) and long.all():
            break
        at, piece = kept[long], piece[long]
    if len(at):
        cut = np.flatnonzero(np.diff(piece)) + 1
        for part in np.split(at, cut):
            yield int(part[0]), int(part[-1]) + 1


def runs_of_words(words: list, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a list of words, by start and period."""
    number: dict = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for a, b in _stretches(codes, times, least):
        part = np.unique(codes[a:b], return_inverse=True)[1]
        found += [(s + a, e + a, q) for s, e, q in runs_of(part, times, least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that any run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, end, q in runs:
        change[start + q] += 1
        change[end] -= 1
    return np.cumsum(change[:-1]) == 0


def _best(runs: list[tuple[int, int, int]]):
    best = None
    for start, end, q in runs:  # in order, so that only a greater exponent replaces one
        if best is None or (end - start) * best[2] > best[1] * q:
            best = (start, end - start, q)
    return best


def periodic_text(doc_id: int | None, words: list) -> list:
    """The words of the query's rewritten documents: those of one in ten repeat a stretch of themselves to their end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def detect(docs: DataFrame, rewrite: Callable[[int | None, list], list] | None = None, times: int = TIMES, least: int = LEAST, keep_text: bool = False) -> DataFrame:
    """doc_id and, of each document, the runs, the strongest of them and digests; with ``keep_text`` the collapsed text and the list of runs too."""
    schema = f"doc_id long, {SCHEMA}" + (", collapsed string, runs array<struct<start:long,length:long,period:long>>" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                found = runs_of_words(words, times, least)
                best = _best(found)
                keep = kept_words(len(words), found)
                collapsed = b" ".join(words if not found else [words[i] for i in np.flatnonzero(keep)])
                listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
                row = [doc_id, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()]
                rows.append(row + ([collapsed.decode(errors="replace"), [{"start": s, "length": e - s, "period": q} for s, e, q in found]] if keep_text else []))
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["collapsed", "runs"] * keep_text
    run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.string(), pa.list_(run_kind)] * keep_text
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, schema)
