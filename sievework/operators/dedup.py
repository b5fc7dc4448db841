"""Exact, normalised and SimHash near-duplicate detection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import character_ngrams, duplicate_text, hamming, md5_bits
from sievework.sources.files import stored

from . import scan

BITS = 64
#: Grams whose bits a task remembers, rows of a vote matrix at once.
REMEMBERED, ROWS = 1 << 20, 1 << 15
#: Blocks that a key of near_pairs() joins on, besides those that may differ.
SHARED = 3


def simhash(df: DataFrame, key: str, text: Column, n: int = 3, letters_only: bool = False, bits64: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, simhash: bit b is set if the votes of all n-gram occurrences for it are not negative.

    Equal grams of a text are counted before they vote. Hashes are the first 64
    bits of MD5, which every engine has; ``bits64`` gives other ones, such as
    functions.text.blake2b_bits. Bit 63 is the sign of the number. A text without
    grams has no votes, so all bits are set; null texts are left out. With
    ``letters_only`` grams are those of functions.text.duplicate_text, and a text
    without letters has the empty gram.
    """
    shown = duplicate_text(text) if letters_only else text
    grams = character_ngrams(shown, n)
    if letters_only:
        grams = F.when(shown == "", F.array(F.lit(""))).otherwise(grams)
    rows = df.where(text.isNotNull())
    if bits64 is None and n <= scan.LONGEST:
        kind = df.schema[key].dataType.simpleString()
        names = [f"v{b}" for b in range(BITS)]
        # votes of a text are made where it is read; rows of one key are one text
        each = rows.select(key, shown.alias("text")).mapInArrow(_votes(n, letters_only), f"{key} {kind}, " + ", ".join(f"{v} long" for v in names))
        votes = each.groupBy(key).agg(*[F.sum(v).alias(v) for v in names])
    else:
        hashes = bits64 or (lambda gram: md5_bits(gram, BITS // 4))
        each = rows.select(key, F.explode_outer(grams).alias("gram"))
        hashed = each.groupBy(key, "gram").agg(F.count("gram").alias("n")).select(key, "n", hashes(F.col("gram")).alias("h"))
        votes = hashed.groupBy(key).agg(*[F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"v{b}") for b in range(BITS)])
    value = F.lit(0).cast("long")
    for b in range(BITS):
        value = value.bitwiseOR(F.when(F.col(f"v{b}") >= 0, F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(key, value.alias("simhash"))


def _signs(gram: str) -> np.ndarray:
    """1 or -1 for each bit of the gram's hash, bit 0 first."""
    bits = np.unpackbits(np.frombuffer(hashlib.md5(gram.encode()).digest()[: BITS // 8], np.uint8))[::-1]
    return bits.astype(np.int8) * 2 - 1


def _votes(n: int, letters_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, signs = np.zeros(0, np.int64), np.zeros((0, BITS), np.int8)
        empty = _signs("")
        for batch in batches:
            for slab in scan.slabs(batch, ROWS):
                chars, row, size = scan.grams(slab.column(1), n)
                own, where = np.unique(scan.codes(chars), return_inverse=True)
                if len(codes) > REMEMBERED:
                    codes, signs = codes[:0], signs[:0]
                new = own[~np.isin(own, codes)]
                if len(new):
                    made = np.stack([_signs(scan.gram(c, n)) for c in new.tolist()])
                    order = np.argsort(codes := np.concatenate([codes, new]))
                    codes, signs = codes[order], np.concatenate([signs, made])[order]
                place = np.searchsorted(codes, own)
                pairs, many = np.unique(row * np.int64(max(len(own), 1)) + where, return_counts=True)
                of, at = pairs // max(len(own), 1), place[pairs % max(len(own), 1)]
                votes = np.zeros((slab.num_rows, BITS), np.int64)
                for a in range(0, len(pairs), ROWS):
                    some = slice(a, a + ROWS)
                    first = np.flatnonzero(np.diff(of[some], prepend=-1))
                    votes[of[some][first]] += np.add.reduceat(signs[at[some]] * many[some, None], first, axis=0)
                if letters_only:
                    votes[size == 0] += empty
                yield pa.RecordBatch.from_arrays([slab.column(0), *[pa.array(v) for v in votes.T.copy()]], [batch.schema.names[0], *[f"v{b}" for b in range(BITS)]])

    return run


def near_pairs(hashes: DataFrame, key: str, distance: int = 3) -> DataFrame:
    """(a, b, distance) of equal or near hashes, a < b.

    Of distance + SHARED blocks of the hash, SHARED are equal in any such pair, so
    there is a key for each choice of them: for a distance of 3 twenty keys of 30
    bits or more, which few unrelated hashes share. Documents with the same hash
    are one node, paired only with the first of them, so a group of n copies gives
    n - 1 rows instead of all its pairs.
    """
    hashes = stored(hashes, "hashes")  # read for the nodes and for their copies
    blocks = distance + SHARED
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(masks, SHARED)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    nodes = hashes.groupBy("simhash").agg(F.min(key).alias("first"))
    banded = nodes.select("simhash", F.col("first"), F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("band", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    # sizes are estimated without the bands, so a broadcast could be twenty times what the planner expects
    met = a.join(b.hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.simhash") < F.col("b.simhash")))
    far = hamming(F.col("a.simhash"), F.col("b.simhash"))
    near = met.where(far <= distance).select(F.least("a.first", "b.first").alias("a"), F.greatest("a.first", "b.first").alias("b"), far.cast("int").alias("distance")).distinct()
    same = hashes.join(nodes.hint("merge"), "simhash").where(F.col(key) != F.col("first")).select(F.col("first").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(same)


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by aggregation (a hot key needs no window)."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def split_overlap(df: DataFrame, split: str, fingerprint: str) -> DataFrame:
    """Distinct fingerprints that each pair of splits shares."""
    d = df.select(split, fingerprint).distinct()
    a, b = d.alias("a"), d.alias("b")
    met = a.join(b, (F.col(f"a.{fingerprint}") == F.col(f"b.{fingerprint}")) & (F.col(f"a.{split}") < F.col(f"b.{split}")))
    return met.groupBy(F.col(f"a.{split}").alias("split_a"), F.col(f"b.{split}").alias("split_b")).agg(F.count("*").alias("shared"))


def assert_isolated(df: DataFrame, split: str, group: str) -> DataFrame:
    """df; its evaluation fails if a group is in two splits."""
    mixed = df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1").limit(1).count()
    if mixed:
        raise ValueError(f"a {group} is in several splits")
    return df
