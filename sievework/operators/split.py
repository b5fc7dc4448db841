"""Group-isolated splits, samples and batches."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import md5_bits
from sievework.sources.files import stored

from .ranks import placed, seeded_order

UNIT = 10_000
#: Rows that one task stratifies one by one.
ONE_BY_ONE = 1_000_000


def temporal_split(df: DataFrame, group: str, date: str, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """group, split: groups by their first date, the last ones for test and the ones before for validation.

    Groups without a date are dealt by a hash of their id. Ranks are of groups,
    counted by date first, so one task sorts dates and not rows.
    """
    groups = df.groupBy(group).agg(F.min(date).alias("first"))
    dated, undated = groups.where("first is not null"), groups.where("first is null")
    days = dated.groupBy("first").agg(F.count("*").alias("n"))
    before = days.select("first", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = dated.join(before, "first").withColumn("__k", F.col("before") + F.row_number().over(Window.partitionBy("first").orderBy(group)) - 1)
    train_end, validation_end = F.floor(F.col("total") * F.lit(1 - validation - test)), F.floor(F.col("total") * F.lit(1 - test))
    named = ranked.select(group, F.when(F.col("__k") < train_end, "train").when(F.col("__k") < validation_end, "validation").otherwise("test").alias("split"))
    u = F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("long") % UNIT / UNIT
    dealt = undated.select(group, F.when(u < 1 - validation - test, "train").when(u < 1 - test, "validation").otherwise("test").alias("split"))
    return named.unionByName(dealt)


def _by_rarity(df: DataFrame, key: str, labels: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows of key, sig, h; label, n): each row's different labels, the rarest first, and every label's number of rows."""
    rows = df.select(key, F.array_distinct(F.array_compact(labels)).alias("labels"), seeded_order(F.col(key), seed).alias("h"))
    support = rows.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    each = rows.select(key, "h", F.explode_outer("labels").alias("label")).join(support, "label", "left")
    rarest = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("n", "label")))))
    return each.groupBy(key, "h").agg(F.transform(rarest, lambda x: x["label"]).alias("sig")), support


def _whole_shares(rows: DataFrame, key: str, group: list[str], shares: list[float]) -> DataFrame:
    """rows with ``k``: the split, as far as whole shares of the group go but one; null for the rest, fewer rows than twice the splits."""
    ends, total = [], F.lit(0)
    for s in shares:
        total = total + F.greatest(F.lit(0), F.floor(F.col("members") * s + 1e-9) - 1)
        ends.append(total)
    k = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(ends))):
        k = F.when(F.col("place") < end, i).otherwise(k)
    return placed(rows, group, "h", [key]).withColumn("k", k).drop("place", "members")


def _greedy(rows: list[tuple], need: dict, room: list[float]) -> list[int]:
    """Iterative stratification of a few rows (labels): the label with the fewest rows left first, each row to the split that misses its labels most."""
    out: list = [None] * len(rows)
    of = defaultdict(dict)
    for i, labels in enumerate(rows):
        for x in labels:
            of[x][i] = None
    splits = range(len(room))

    def put(i: int) -> None:
        lack = [sorted((need[x][k] for x in rows[i]), reverse=True) for k in splits]
        # what is gained by a row is the fall of the squared lacks, which is greatest where they are
        out[i] = max(splits, key=lambda k: (sum(2 * v - 1 for v in lack[k]), room[k], -k))
        room[out[i]] -= 1
        for x in rows[i]:
            need[x][out[i]] -= 1
            of[x].pop(i, None)

    while left := {x: m for x, m in of.items() if m}:
        x = min(left, key=lambda x: (len(left[x]), str(x)))
        for i in list(of[x]):
            put(i)
    for i, done in enumerate(out):
        if done is None:
            put(i)
    _repaired(rows, out, need, room)
    return out


def _repaired(rows: list[tuple], out: list[int], need: dict, room: list[float]) -> None:
    """Moves rows as long as the fourth powers of the labels' lacks, and the squares of the splits', fall."""

    def change(labels, k: int, step: int) -> float:
        """By how much they fall if a row of these labels joins (1) or leaves (-1) a split."""
        return sum(need[x][k] ** 4 - (need[x][k] - step) ** 4 for x in labels) + (2 * step * room[k] - 1)

    def move(i: int, k: int) -> None:
        for x in rows[i]:
            need[x][out[i]] += 1
            need[x][k] -= 1
        room[out[i]] += 1
        room[k] -= 1
        out[i] = k

    for _ in range(20):
        moved = False
        for i, labels in enumerate(rows):
            gains = [(change(labels, k, 1) + change(labels, out[i], -1), -k) for k in range(len(room)) if k != out[i]]
            best = max(gains, default=(0, 0))
            if best[0] > 1e-9:
                move(i, -best[1])
                moved = True
        if not moved:
            break


def stratified_split(df: DataFrame, key: str, labels: str, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """key, split: multilabel rows, so that every label has its share of each split in the whole table.

    Rows with the same labels are dealt by whole shares but one, in a seeded order.
    What is left, fewer rows of each set of labels than twice the splits, is
    stratified one by one, by what each label still lacks in each split of the whole table;
    more than ``ONE_BY_ONE`` such rows are dealt to several tasks of that size, each
    with its part of what is lacking. Keys are unique; the result does not depend
    on partitions.
    """
    names, shares = list(ratios), list(ratios.values())
    rows, support = _by_rarity(df, key, labels, seed)
    first = stored(_whole_shares(rows, key, ["sig"], shares), "shares")
    dealt, rest = first.where("k is not null"), first.where("k is null").select(key, "sig", "h")
    # rows of labels and splits come to the driver, and none of the table
    left = rest.count()
    parts = max(1, -(-left // ONE_BY_ONE))
    room = [0.0] * len(names)
    total = left
    for r in dealt.groupBy("k").agg(F.count("*").alias("n")).collect():
        room[r["k"]] -= r["n"]
        total += r["n"]
    room = [(x + total * s) / parts for x, s in zip(room, shares)]
    need = {r["label"]: [r["n"] * s for s in shares] for r in support.collect()}
    for r in dealt.select("k", F.explode("sig").alias("label")).groupBy("label", "k").agg(F.count("*").alias("n")).collect():
        need[r["label"]][r["k"]] -= r["n"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["h", key])
        k = _greedy([tuple(x) for x in own["sig"]], {x: [n / parts for n in v] for x, v in need.items()}, list(room))
        return pd.DataFrame({key: own[key], "k": k})

    kind = df.schema[key].dataType.simpleString()
    last = rest.withColumn("__part", F.pmod("h", F.lit(parts))).groupBy("__part").applyInPandas(run, f"{key} {kind}, k int")
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("k"))
    return dealt.select(key, "k").unionByName(last).select(key, named.alias("split"))


def coverage_subset(df: DataFrame, key: str, labels: str, size: int, seed: int = 42) -> DataFrame:
    """key, labels of ``size`` rows: rare labels first, then a stratified sample.

    Labels are taken by their number of rows (then by name); one that no chosen
    row has yet gets the row that adds most labels, of these the one whose labels
    have the fewest rows, then the first in the seeded order. Of rows with the same
    labels only the first one can be chosen, so each round looks at one row of
    each set of labels; the labels covered so far are all that the driver keeps.
    The rest is filled by ``stratified_split`` and cut or filled up in the seeded
    order to the exact size. Keys are unique.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    rows, support = _by_rarity(df, key, labels, seed)
    rows = stored(rows, "rows")
    if size >= rows.count():
        return rows.select(key, F.array_sort("sig").alias("labels"))
    counts = {r["label"]: r["n"] for r in support.collect()}  # a row for each label
    of = rows.where(F.size("sig") > 0).select(key, "h", "sig", F.explode("sig").alias("label")).join(support, "label").groupBy(key, "h", "sig").agg(F.sum("n").alias("total"))
    heads = stored(of.groupBy("sig").agg(F.min("total").alias("total"), F.min(F.struct("h", key)).alias("head")), "heads")
    covered: set = set()
    chosen: list = []
    for label in sorted(counts, key=lambda x: (counts[x], x)):
        if label in covered or len(chosen) >= size:
            continue
        known = F.array(*[F.lit(x) for x in sorted(covered)]) if covered else F.array().cast(f"array<{dict(support.dtypes)['label']}>")
        best = heads.where(F.array_contains("sig", F.lit(label))).agg(F.min(F.struct((-F.size(F.array_except("sig", known))).alias("more"), "total", "head", "sig")).alias("b")).first()["b"]
        chosen.append(best["head"][key])
        covered |= set(best["sig"])
    taken = df.sparkSession.createDataFrame([(x,) for x in chosen], df.select(key).schema) if chosen else rows.select(key).limit(0)
    others = rows.join(taken, key, "left_anti")
    left = size - len(chosen)
    if left > 0:
        n = others.count()
        # the split sees the labels by their rows among the others
        parts = stored(stratified_split(others, key, "sig", {"in": left / n, "out": 1 - left / n}, seed), "parts")
        inside = parts.where("split = 'in'").count()
        ranked = placed(parts.withColumn("h", seeded_order(F.col(key), seed)), ["split"], "h", [key])
        more = ranked.where(F.when(F.col("split") == "in", F.col("place") < left).otherwise(F.col("place") < max(left - inside, 0)))
        taken = taken.unionByName(more.select(key))
    return rows.join(taken, key, "left_semi").select(key, F.array_sort("sig").alias("labels"))


def _bucket(length: str, edges: list[int], closed: bool) -> Column:
    """The number of edges up to a length; with ``closed`` an edge belongs to the bucket below it."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e < F.col(length) if closed else e <= F.col(length)))


def length_buckets(df: DataFrame, key: str, length: str, edges: list[int], batch: int, seed: int = 42) -> DataFrame:
    """key, bucket, batch: rows of similar length, batched in a seeded order."""
    rows = df.select(key, length, _bucket(length, edges, False).alias("bucket"), seeded_order(F.col(key), seed).alias("__h"))
    return placed(rows, ["bucket"], "__h", [key]).select(key, length, "bucket", F.floor(F.col("place") / batch).alias("batch"))


def token_budget_batches(df: DataFrame, key: str, length: str, edges: list[int], budget: int, seed: int = 42) -> DataFrame:
    """Batches of a bucket as large as its padded length lets a token budget hold."""
    array = F.array(*[F.lit(e).cast("long") for e in edges])
    rows = df.select(key, length, _bucket(length, edges, True).alias("bucket"), seeded_order(F.col(key), seed).alias("__h"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.coalesce(F.get(array, F.col("bucket")), F.col(length))))
    return placed(rows, ["bucket"], "__h", [key]).select(key, length, "bucket", F.floor(F.col("place") / fits).alias("batch"))


def epoch_order(key: Column, seed: int, epoch: int, salt: str = "") -> Column:
    """An evenly spread long of a key, by seed and epoch; the first 60 bits of an MD5, over the whole range of longs."""
    bits = md5_bits(F.concat_ws(":", F.lit(salt), key.cast("string"), F.lit(seed + epoch)))
    return (bits - F.lit(1 << 59)) * 16


def token_batches(df: DataFrame, key: str, length: str, edges: list[int], batch: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """One epoch of training batches: key, length, bucket, batch (from 0, in the epoch's order), place, rows and loss_scale.

    Buckets are cut into whole batches in a seeded order that changes with the
    epoch. What is left of all buckets is shuffled together and batched, as bucket
    -1. A batch with fewer rows than ``batch`` has them weighted by its share, so that
    each row counts the same. Lengths have to be positive and edges ascending;
    keys are unique.
    """
    if batch <= 0 or list(edges) != sorted(set(edges)):
        raise ValueError("the batch has to be positive, edges unique and ascending")
    checked = F.when(F.col(length) > 0, F.col(length)).otherwise(F.raise_error(F.lit("lengths have to be positive")))
    rows = df.select(key, checked.alias(length)).select(key, length, _bucket(length, edges, False).alias("bucket"), epoch_order(F.col(key), seed, epoch).alias("__h"))
    whole = placed(rows, ["bucket"], "__h", [key]).withColumn("__left", F.col("place") >= F.col("members") - F.col("members") % batch)
    full = whole.where("not __left").select(key, length, "bucket", F.floor(F.col("place") / batch).alias("__i"), (F.col("place") % batch).alias("place"))
    rest = whole.where("__left").select(key, length, epoch_order(F.col(key), seed, epoch, "rest").alias("__h"), F.lit(-1).alias("bucket"))
    pooled = placed(rest, ["bucket"], "__h", [key]).select(key, length, "bucket", F.floor(F.col("place") / batch).alias("__i"), (F.col("place") % batch).alias("place"))
    dealt = full.unionByName(pooled)
    name = F.concat_ws("/", "bucket", "__i")
    batches = dealt.groupBy("bucket", "__i").agg(F.count("*").alias("rows")).withColumns({"__h": epoch_order(name, seed, epoch, "batch"), "__all": F.lit(0)})
    ordered = placed(batches, ["__all"], "__h", ["bucket", "__i"]).select("bucket", "__i", "rows", F.col("place").alias("batch"))
    return dealt.join(ordered, ["bucket", "__i"]).select(key, length, "bucket", "batch", "place", "rows", (F.col("rows") / batch).alias("loss_scale"))
