"""Repair of conversation structure by the cheapest edits.

A conversation's rows are taken by turn (nulls first; equal turns by role and
text). Each row's first fault counts: blank, duplicate (role and text seen
earlier in the conversation), truncated (the last character that is no space
ends no sentence). The repaired roles, by their initials, are ``(s?(ua)+)?``.
Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty
user or assistant row 5; blank and duplicate rows have to be deleted; a truncated
row that stays adds 5.

The edits are found by Dijkstra's algorithm on the lattice of (row, state of the
grammar), which is never built: the queue is ordered by (cost, audit), where the
audit is the string of the edits' initials, and the search stops at the first
end node that it takes. Two ways to one node with equal costs never have an audit
that begins the other one (more inserts would cost more), so the least audit of
a node is part of the least audit through it. Audits are nodes of a tree with
jump pointers: one takes a few bytes, and two are compared in logarithmic time.

Plan: one shuffle by conversation gives places, faults and a code of one
character a row; codes (never texts) are gathered into a string for the search;
then a conversation's audit and its rows stream through one more shuffle, so that
a conversation of any length is repaired and hashed with a row in memory at a
time. Its rows are in one task, as the order of one conversation demands.

Nulls and edge cases: null roles and texts count as one space; a null turn
comes first and takes no part in the gaps; rows without conversation id are one
conversation; repeated rows are duplicates; a conversation without rows, if its
id is given, has zeros, an empty audit and the hash of an empty string; other
columns of the input are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import storage

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
#: Searches are kept for codes up to this length.
SHORT = 256

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Audits:
    """Strings as nodes of a tree; 0 is the empty one."""

    def __init__(self):
        self.parent, self.depth, self.jump, self.letter = array("i", [0]), array("i", [0]), array("i", [0]), bytearray(b"\0")

    def add(self, parent: int, letter: str) -> int:
        depth, jump = self.depth, self.jump
        near = jump[parent]
        far = jump[near]
        self.parent.append(parent)
        self.jump.append(far if depth[parent] - depth[near] == depth[near] - depth[far] else parent)
        self.letter.append(ord(letter))
        depth.append(depth[parent] + 1)
        return len(depth) - 1

    def _lift(self, a: int, depth: int) -> int:
        while self.depth[a] > depth:
            a = self.jump[a] if self.depth[self.jump[a]] >= depth else self.parent[a]
        return a

    def before(self, a: int, b: int) -> bool:
        """Whether a sorts before b."""
        least = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, least), self._lift(b, least)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.letter[x] < self.letter[y]

    def text(self, a: int) -> str:
        out = bytearray()
        while a:
            out.append(self.letter[a])
            a = self.parent[a]
        return out[::-1].decode()


class _Key:
    __slots__ = ("audits", "at")

    def __init__(self, audits: _Audits, at: int):
        self.audits, self.at = audits, at

    def __lt__(self, other: _Key) -> bool:
        return self.audits.before(self.at, other.at)


def _edits(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits of a row in a state of the grammar."""
    yield DELETE, "D", state
    if code == "x":
        return
    extra = TRUNCATED if code.isupper() else 0
    wanted = _ASSISTANT if state == _USER else _USER
    own = _INITIAL.get(code.lower())
    if own == wanted or own == _SYSTEM and state == _START:
        yield KEEP + extra, "K", own
    yield REROLE + extra, "R", wanted


def _search(codes: str) -> tuple[int, str]:
    n = len(codes)
    audits, done = _Audits(), bytearray(4 * (n + 1))
    queue = [(0, _Key(audits, 0), 0, _START)]
    while queue:
        cost, key, row, state = heapq.heappop(queue)
        if done[4 * row + state]:
            continue
        done[4 * row + state] = 1
        if row == n and state in (_START, _ASSISTANT):
            return cost, audits.text(key.at)
        after = _ASSISTANT if state == _USER else _USER
        ways = [(INSERT, "I", after, row)]
        if row < n:
            ways += [(*edit, row + 1) for edit in _edits(codes[row], state)]
        for more, letter, to, at in ways:
            if not done[4 * at + to]:
                heapq.heappush(queue, (cost + more, _Key(audits, audits.add(key.at, letter)), at, to))
    raise AssertionError("an end is always reached by deleting all rows")


_known = lru_cache(1 << 14)(_search)


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation: a character a row, x where it has to go, else s, u, a or o by its initial, in capitals if truncated."""
    return _known(codes) if len(codes) <= SHORT else _search(codes)


@F.pandas_udf(StructType([StructField("cost", LongType()), StructField("audit", StringType())]))
def _cheapest(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cheapest(c) for c in codes], columns=["cost", "audit"])


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with each row's place (from 1), fault, code and whether it follows illegally or opens a turn."""
    # windows over parts of a conversation need no shuffle of their own
    conversation = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    spaceless = F.rtrim(F.col("text"), F.lit(SPACES))
    pair = F.concat(_initial(F.lag("role").over(conversation)), _initial(F.col("role")))
    initial = _initial(F.col("role"))
    first = F.row_number().over(conversation) == 1
    return (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        .select("*", F.row_number().over(conversation).cast("long").alias("place"), (~first & ~pair.isin("su", "ua", "au")).alias("illegal"), (F.col("turn").isNotNull() & (first | ~F.col("turn").eqNullSafe(F.lag("turn").over(conversation)))).alias("opens"))
        .withColumn("seen", F.row_number().over(same) > 1)
        .withColumn("fault", F.when(spaceless == "", "blank").when(F.col("seen"), "duplicate").when(~F.substring(spaceless, -1, 1).isin(".", "!", "?"), "truncated"))
        .withColumn("known", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
        .withColumn("code", F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("known")).otherwise(F.col("known")))
        .drop("seen", "known")
    )


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation: gaps, numbers of faults and illegal neighbours, cost and audit; rows come from ``placed``, ids are conversations that have a row in any case."""
    of = rows.select("conv_id", "turn", "place", "opens", "fault", "illegal", "code")
    if ids is not None:
        of = of.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)

    def count(what: Column) -> Column:
        return F.coalesce(F.sum(what.cast("long")), F.lit(0).cast("long"))

    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "code")))), lambda r: r["code"]), "")
    found = of.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("opens")), F.lit(0).cast("long")).alias("gaps"),
        *(count(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        joined.alias("codes"),
    )
    return found.withColumn("found", _cheapest("codes")).select("conv_id", *_COUNTS[:-1], "found.cost", "found.audit")


class _Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        role = "assistant" if self.last == "u" else "user"
        self.last = role[0]
        return role

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    rest = _inserted

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[0]
            yield "K", role, text
        elif edit == "R":
            yield "R", self._next(), text


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's audit at place 0, then its rows."""
    heads = found.select("conv_id", F.lit(0).cast("long").alias("place"), F.col("audit").alias("text"), *_COUNTS)
    return heads.unionByName(rows.select("conv_id", "place", "role", "text"), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _turned(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role, text and the edit (K, R or I) of each row."""
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        repair, conv, n = None, None, 0

        def take(edits) -> None:
            nonlocal n
            for edit, role, text in edits:
                n += 1
                out.append((conv, n, role, text, edit))

        for conv_id, place, role, text in _turned(batches, ["conv_id", "place", "role", "text"]):
            if place == 0:
                if repair:
                    take(repair.rest())
                repair, conv, n = _Repair(text), conv_id, 0
            else:
                take(repair.row(role, text))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)
                out.clear()
        if repair:
            take(repair.rest())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    return _streamed(rows, found).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row a conversation: its numbers, audit and the SHA-256 of its repaired rows ``role:text``, joined by newlines."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    kinds = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        repair = head = digest = None
        some = False

        def take(edits) -> None:
            nonlocal some
            for _, role, text in edits:
                digest.update(("\n" * some + role + ":" + text).encode())
                some = True

        def close() -> None:
            if repair:
                take(repair.rest())
                out.append((*head, repair.audit, digest.hexdigest()))

        for conv_id, place, role, text, *counts in _turned(batches, ["conv_id", "place", "role", "text", *_COUNTS]):
            if place == 0:
                close()
                repair, head, digest, some = _Repair(text), (conv_id, *counts), hashlib.sha256(), False
            else:
                take(repair.row(role, text))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return _streamed(rows, found).mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))


def repair(rows: DataFrame, ids: DataFrame | None = None, keep_rows: bool = False) -> DataFrame:
    """The digests of the repaired conversations, or with ``keep_rows`` their rows."""
    kept = storage.stored(placed(rows), "placed")
    found = audits(kept, ids)
    return repaired(kept, found) if keep_rows else digests(kept, found)


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties it, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    one_space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one_space) for c in ("conv_id", "turn"))).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", F.coalesce("role", one_space).alias("role"), F.coalesce("text", one_space).alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))).alias("copy"))
        .drop("copy")
    )
