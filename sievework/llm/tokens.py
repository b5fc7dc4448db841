"""Token ids of whole Arrow text columns with a public tokenizer file.

The tokenizer's pre-tokenizer drops white space and never joins text across it,
so a text's ids are the ids of its space-separated chunks in order; a chunk is
encoded once and its ids are kept (at most ``CACHE`` chunks and ``CACHE_BYTES``,
then afresh). Kept chunks are found by their hash, and their bytes are compared
before their ids are used. The tests compare this with encoding whole texts.
"""

from __future__ import annotations

import os
import zlib

import numpy as np

from . import textops

#: Chunks whose ids are kept in a worker.
CACHE = 1_500_000
#: Bytes of chunks that are kept, about.
CACHE_BYTES = 32_000_000

DEFAULT_FILE = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes byte columns; keeps the ids of chunks by their hash."""

    def __init__(self, path: str, most: int = CACHE):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None) or "</w>"
        size = self.tok.get_vocab_size()
        self.ends = np.zeros(size + 1, dtype=bool)
        for word, i in self.tok.get_vocab().items():
            self.ends[i] = word.endswith(suffix)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.raw, self.raw_at, self.raw_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, lengths, flat ids): the ids of chunks[order[0]], chunks[order[1]] and so on.

        Chunks of letters are single words, so many are encoded as one text and
        cut behind the tokens that end a word.
        """
        order, sizes, flat = [], [], []
        rest = []
        plain = []
        for i, c in enumerate(chunks):
            (plain if c.isalpha() else rest).append(i)
        for k in range(0, len(plain), 512):
            group = plain[k : k + 512]
            ids = np.array(self.tok.encode(" ".join([chunks[i] for i in group]), add_special_tokens=False).ids, dtype=np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                order += group
                sizes.append(np.diff(cut, prepend=0))
                flat.append(ids)
            else:
                rest += group
        for k in range(0, len(rest), 4096):
            group = rest[k : k + 4096]
            got = [e.ids for e in self.tok.encode_batch_fast([chunks[i] for i in group], add_special_tokens=False)]
            order += group
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter((i for ids in got for i in ids), np.uint32))
        return np.array(order, dtype=np.int64), np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.uint32), *flat])

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """keys: sorted and unknown."""
        order, size, ids = self._encode_chunks([x.decode("utf-8", "replace") for x in chunks])
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(need, 2 * self.used) - self.used, np.uint32)])
        self.pool[self.used : need] = ids
        at, sizes = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        at[order], sizes[order] = self.used + np.cumsum(size) - size, size
        self.used = need
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, sizes)
        raw_size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        raw_at = len(self.raw) + np.cumsum(raw_size) - raw_size
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(chunks), np.uint8)])
        self.raw_at, self.raw_size = np.insert(self.raw_at, where, raw_at), np.insert(self.raw_size, where, raw_size)

    def _strange(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Words (by number) whose bytes aren't those of the kept chunk at pos: other words of the same hash."""
        size = e - s
        odd = size != self.raw_size[pos]
        kept, same = np.where(odd, 0, self.raw_at[pos]), np.where(odd, 0, size)
        end = np.cumsum(same)
        step = np.arange(end[-1]) - np.repeat(end - same, same)
        differs = data[np.repeat(s, same) + step] != self.raw[np.repeat(kept, same) + step]
        if differs.any():
            odd[np.searchsorted(end, np.flatnonzero(differs), side="right")] = True
        return np.flatnonzero(odd)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) and n+1 offsets of the documents; each ends with ``end_id``."""
        n = len(off) - 1
        lower = b"<|" not in data.tobytes()
        low = textops._LOWER[data] if lower else data
        stop = np.flatnonzero((low == 44) | (low == 46))
        stop = stop[stop > 0]
        left = low[stop - 1] | 32
        h, s, e, at = textops.words(low, off, textops.SPACE, lower=False, cuts=stop[(left >= 97) & (left <= 122)])
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(keys):
            pos = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), dtype=bool)
            inside = pos < len(self.keys)
            known[inside] = self.keys[pos[inside]] == keys[inside]
            if not known.all():
                raw, lost = low.tobytes(), np.flatnonzero(~known)
                if len(self.keys) + len(lost) > self.most or len(self.raw) > CACHE_BYTES:
                    self._clear()
                    lost = np.arange(len(keys))
                where = zip(s[first[lost]].tolist(), e[first[lost]].tolist())
                self._learn(keys[lost], [raw[a:b] for a, b in where])
                pos = np.searchsorted(self.keys, keys)
            size = self.size[pos][inv]
            begin = self.at[pos][inv]
            pool = self.pool
            odd = self._strange(low, s, e, pos[inv])
            if len(odd):
                raw = low.tobytes()
                order, sizes, ids = self._encode_chunks([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[odd].tolist(), e[odd].tolist())])
                size[odd[order]], begin[odd[order]] = sizes, self.used + np.cumsum(sizes) - sizes
                pool = np.concatenate([pool[: self.used], ids])
        else:
            size = begin = np.zeros(0, np.int64)
            pool = self.pool
        total = np.concatenate([[0], np.cumsum(size)])
        per_doc = total[at[1:]] - total[at[:-1]]
        flat = pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
        if end_id is None:
            return flat, np.concatenate([[0], np.cumsum(per_doc)])
        out_off = np.concatenate([[0], np.cumsum(per_doc + 1)]).astype(np.int64)
        out = np.full(out_off[-1], end_id, dtype=np.uint32)
        body = np.ones(out_off[-1], dtype=bool)
        body[out_off[1:] - 1] = False
        out[body] = flat
        return out, out_off


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, most: int = CACHE) -> ChunkEncoder:
    """One encoder for each tokenizer file, number of kept chunks and Python worker."""
    if (path, most) not in _encoders:
        _encoders[path, most] = ChunkEncoder(path, most)
    return _encoders[path, most]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
