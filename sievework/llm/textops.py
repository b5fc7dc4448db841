"""Vectorised byte-level text routines shared by the operators of this subpackage.

Everything works on Arrow string columns without creating a Python object per
word: a word is a run of non-separator bytes, and its hash is a sum of products of
pseudo-random values of the bytes and of their places in the word, modulo 2**64
(multilinear hashing; a polynomial has colliding words for every base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_GAMMA = _U(0x9E3779B97F4A7C15)

#: Bytes of text handled at once; arrays of 8 bytes per text byte are made from it.
SLAB = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = _table([(9, 13), (32, 32)])
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
NON_ALNUM = _table([(0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix((np.arange(256, dtype=_U) + _U(1)) * _GAMMA)
_places = np.zeros(0, dtype=_U)


def places(n: int) -> np.ndarray:
    """Values of the first n places of a word; odd, so that each byte counts in full."""
    global _places
    if len(_places) < n:
        _places = mix((np.arange(1 << max(n - 1, 1).bit_length(), dtype=_U) + _U(257)) * _GAMMA) | _U(1)
    return _places[:n]


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column as strings, nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets, from 0."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slabs(batches: Iterator[pa.RecordBatch], name: str, limit: int = SLAB) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = byte_view(text_column(batch, name))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _piece_ends(data: np.ndarray, sep: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long byte array in front of separators."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + limit)
        if end < n:
            found = np.flatnonzero(sep[data[at:end]])
            if len(found):
                end = at + int(found[-1]) + 1
            else:
                more = np.flatnonzero(sep[data[end:]])
                end = end + int(more[0]) + 1 if len(more) else n
        yield at, end
        at = end


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: bool = True, cuts: np.ndarray | None = None):
    """Hashes, starts, ends (in bytes) and first-word indexes (n_docs + 1) of all words.

    A word never spans two documents; ``cuts`` are more positions at which a
    word has to end.
    """
    if lower:
        data = _LOWER[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    if cuts is not None:
        first[cuts] = True
    hs, ss, es = [], [], []
    for a, b in [(0, len(data))] if len(data) <= 2 * SLAB else _piece_ends(data, sep, SLAB):
        d = data[a:b]
        if not len(d):
            continue
        own = ~sep[d]
        begin, close = own.copy(), own.copy()
        begin[1:] &= ~own[:-1] | first[a + 1 : b]
        close[:-1] &= ~own[1:] | first[a + 1 : b]
        s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        size = e - s
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
        c = np.zeros(len(at) + 1, dtype=_U)
        np.cumsum(_BYTES[d[own]] * places(int(size.max(initial=1)))[at], out=c[1:])
        hs.append(mix(c[end] - c[end - size] + size.astype(_U) * _GAMMA))
        ss.append(s + a)
        es.append(e + a)
    if not hs:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(off), np.int64)
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(s, off).astype(np.int64)


def ngrams(h: np.ndarray, at: np.ndarray, n: int):
    """Hashes of the n-grams of consecutive words inside each document, and their indexes.

    Returns (hashes, index of the first word, document index).
    """
    count = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    base = np.concatenate([[0], np.cumsum(count)])
    where = np.arange(base[-1]) - base[doc] + at[doc]
    g = np.zeros(base[-1], dtype=_U)
    for j in range(n):
        g = g * _U(0xD6E8FEB86659FD93) + h[where + j]
    return mix(g + _U(n)), where, doc


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int, sep: np.ndarray = SPACE):
    """Sorted distinct n-word shingle hashes of each document: (hashes, n_docs + 1 offsets).

    A document with fewer words has its whole sequence as one shingle; without
    words its set is empty.
    """
    h, _, _, at = words(data, off, sep)
    g, _, doc = ngrams(h, at, n)
    size = np.diff(at)
    for i in np.flatnonzero((size > 0) & (size < n)):
        own, _, _ = ngrams(h[at[i] : at[i + 1]], np.array([0, size[i]]), int(size[i]))
        g, doc = np.append(g, own), np.append(doc, i)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(off))).astype(np.int64)
