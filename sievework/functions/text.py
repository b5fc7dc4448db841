"""Normalising, fingerprints and n-grams as column expressions."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


#: A character that NFKC may change, or that may be composed with the one before; not all others are listed. ASCII is tested first.
CHANGED = r"[^\x00-\x7f](?<![\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0481\u2012-\u2016\u2018-\u2023\u20ac\u3001-\u3029\u4e00-\u9fff])"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC, for which Spark has no function. Texts without characters that it may change don't leave the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(CHANGED), text)), text)


def normalize_text(text: Column, composed: bool = True) -> Column:
    """NFKC (unless ``composed`` is false), no control characters, white space as single blanks, trimmed."""
    value = nfkc(text) if composed else text
    return F.trim(F.regexp_replace(F.regexp_replace(value, CONTROLS, ""), r"(?U)\s+", " "))


def exact_fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_text(text: Column, composed: bool = True) -> Column:
    """Letters and digits only, in lower case: the same for texts that differ in punctuation and spacing."""
    return F.regexp_replace(F.lower(nfkc(text) if composed else text), r"(?U)[\s\W_]+", "")


def duplicate_group_id(text: Column, composed: bool = True) -> Column:
    return F.concat(F.lit("DG-"), F.substring(F.sha2(duplicate_text(text, composed), 256), 1, 20))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def character_ngrams(text: Column, n: int) -> Column:
    """Overlapping n-grams of the text without white space; a shorter text is one gram, an empty one none.

    Characters are split once and zipped with themselves: substring() would
    scan the text from its start for every gram.
    """
    chars = F.split(compact(text), "")
    grams = chars
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, k + 1, F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    grams = F.slice(grams, 1, F.greatest(F.size(chars) - n + 1, F.lit(1)))
    whole = compact(text)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.length(whole) <= n, F.array(whole)).otherwise(grams)


def ngram_count(text: Column, n: int) -> Column:
    """The size of character_ngrams() without making them."""
    size = F.length(compact(text))
    return F.when(size == 0, 0).otherwise(F.greatest(size - n + 1, F.lit(1)))


def md5_bits(value: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of the MD5 as a number, the same in other engines; of 16 digits as a signed one."""
    head = F.substring(F.md5(value.cast("binary")), 1, digits)
    if digits < 16:
        return F.conv(head, 16, 10).cast("long")
    low = F.conv(F.substring(head, 2, 15), 16, 10).cast("long")
    return F.shiftleft(F.conv(F.substring(head, 1, 1), 16, 10).cast("long"), 60).bitwiseOR(low)


@F.pandas_udf(T.LongType())
def blake2b_bits(values: pd.Series) -> pd.Series:
    """BLAKE2b of eight bytes as a signed number, for which Spark has no function."""
    return pd.Series([None if v is None else int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True) for v in values], dtype="Int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def key_sentences(text: Column, ends: str, limit: int) -> Column:
    """The first sentences, trimmed, empty ones left out."""
    parts = F.split(text, f"(?<=[{ends}])", -1)
    return F.slice(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != ""), 1, limit)


def truncated(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def head_tail(tokens: Column, limit: int) -> Column:
    """The first two thirds and the last third of a budget of tokens."""
    head = (limit * 2) // 3
    return F.when(F.size(tokens) <= limit, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(limit - head), limit - head)))


def head_tail_text(text: Column, limit: int) -> Column:
    """head_tail() of a text's characters."""
    return F.when(F.length(text) <= limit, text).otherwise(F.array_join(head_tail(F.split(text, ""), limit), ""))


def selected_sentences(text: Column, keywords: list[str], limit: int, ends: str, reserve: int = 8) -> Column:
    """The sentences that tell most, in their order, within ``limit - reserve`` characters.

    A sentence counts ten for each keyword it has, and one more if it is the first
    or the last; ties go to the earlier one. Those that don't fit are passed over;
    if the best alone is too long, its head and tail are taken. A text that fits
    or has one sentence only stays.
    """
    budget = limit - reserve

    def chosen(parts: Column, last: Column) -> Column:
        def graded(s: Column, i: Column) -> Column:
            score = sum((F.when(F.contains(s, F.lit(k)), 10).otherwise(0) for k in keywords), F.lit(0)) + F.when((i == 0) | (i == last), 1).otherwise(0)
            return F.struct((-score).alias("worth"), i.alias("i"), s.alias("s"))

        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,s:string>>").alias("kept"))

        def step(state: Column, x: Column) -> Column:
            cut = F.when(F.length(x["s"]) > budget, head_tail_text(x["s"], budget)).otherwise(x["s"])
            full = state["used"] >= budget
            misfit = (F.size(state["kept"]) > 0) & (state["used"] + F.length(x["s"]) > budget)
            more = F.struct((state["used"] + F.length(cut)).alias("used"), F.concat(state["kept"], F.array(F.struct(x["i"].alias("i"), cut.alias("s")))).alias("kept"))
            return F.when(full | misfit, state).otherwise(more)

        best = F.aggregate(F.array_sort(F.transform(parts, graded)), start, step)["kept"]
        return F.when(last < 1, text).otherwise(F.array_join(F.transform(F.array_sort(best), lambda x: x["s"]), ""))

    split = F.filter(F.transform(F.split(text, f"(?<=[{ends}])", -1), lambda s: F.trim(s)), lambda s: s != "")
    # parts and the last place are bound to variables, or each sentence would split the text anew
    listed = F.transform(F.array(split), lambda p: F.struct(p.alias("p"), (F.size(p) - 1).alias("last")))
    return F.when(F.length(text) <= limit, text).otherwise(F.get(F.transform(listed, lambda x: chosen(x["p"], x["last"])), F.lit(0)))


def strip_suffix(text: Column, suffix: str) -> Column:
    """Trimmed, without one trailing suffix."""
    return F.regexp_replace(F.trim(text), f"{suffix}$", "")


def canonical_labels(labels: Column) -> Column:
    """Labels without brackets and white space, distinct, sorted, empty ones left out."""
    clean = F.transform(labels, lambda x: F.regexp_replace(F.translate(x, "[]【】", ""), r"(?U)\s+", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))
