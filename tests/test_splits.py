"""Splits, subsets and batches of whole tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.operators import ranks, split, stats

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def lacks(rows, out, ratios):
    """The greatest distance from a label's share in a split, of labels with ten rows or more."""
    n, got = Counter(), defaultdict(Counter)
    for key, labels in rows:
        for x in set(labels or []):
            n[x] += 1
            got[x][out[key]] += 1
    return max(abs(got[x][k] - n[x] * s) for x in n if n[x] >= 10 for k, s in ratios.items())


@pytest.mark.parametrize("ratios", [RATIOS, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}])
def test_every_label_has_its_share_of_each_split(spark, ratios):
    rng = random.Random(3)
    rows = [(i, [f"l{i % 4}"] + (["rare"] if i % 160 == 7 else [])) for i in range(6400)]
    rows += [(10_000 + i, list({f"m{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(4))})) for i in range(1500)] + [(90_000, None), (90_001, ["l1", None, "l1"])]
    df = spark.createDataFrame(rows, "id long, l array<string>")
    got = [dict(split.stratified_split(df.repartition(n), "id", "l", ratios).collect()) for n in (2, 9)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert lacks([(k, [x for x in l or [] if x]) for k, l in rows], got[0], ratios) <= 1 + 1e-9
    sizes = Counter(got[0].values())
    assert all(abs(sizes[k] - len(rows) * s) <= 3 for k, s in ratios.items())
    if ratios is RATIOS:
        assert Counter(got[0][k] for k, l in rows[:6400] if "rare" in l) == {"train": 32, "validation": 4, "test": 4}
        assert got[0] != dict(split.stratified_split(df, "id", "l", ratios, seed=7).collect())


def plain_cover(rows, size, order):
    """Rarest label first; most new labels, then the fewest rows of all its labels, then the order."""
    n = Counter(x for _, labels in rows for x in set(labels))
    covered, chosen = set(), []
    for label in sorted(n, key=lambda x: (n[x], x)):
        if label in covered or len(chosen) >= size:
            continue
        best = min((r for r in rows if label in r[1] and r[0] not in chosen), key=lambda r: (-len(set(r[1]) - covered), sum(n[x] for x in set(r[1])), order[r[0]]))
        chosen.append(best[0])
        covered |= set(best[1])
    return chosen


def test_a_subset_covers_rare_labels_first(spark):
    def subset(rows, size, seed=42):
        df = spark.createDataFrame(rows, "id long, l array<string>").repartition(3)
        return {r["id"]: r["labels"] for r in split.coverage_subset(df, "id", "l", size, seed).collect()}

    common = [(i, ["a", "b", "c", "d"]) for i in range(10)]
    assert list(subset([*common, (99, ["unique"])], 1)) == [99]
    few = [(0, ["0"]), (1, ["0"]), (2, ["0", "1"]), (3, ["2"]), (4, ["3"]), (5, ["0"])]
    got = subset(few, 4)
    assert len(got) == 4 and {x for v in got.values() for x in v} == {"0", "1", "2", "3"}
    rng = random.Random(5)
    rows = [(i, sorted({f"x{min(int(rng.expovariate(0.15)), 25)}" for _ in range(rng.randrange(0, 4))})) for i in range(700)]
    order = dict(spark.createDataFrame([(i,) for i, _ in rows], "id long").select("id", split.seeded_order(F.col("id"), 42)).collect())
    for size in (3, 8, 120):
        got = subset(rows, size)
        chosen = plain_cover(rows, size, order)
        assert len(got) == size and set(chosen) <= set(got) and got == subset(rows, size)
    full, part = Counter(x for _, v in rows for x in v), Counter(x for v in got.values() for x in v)
    # the fill is stratified: what it adds to the chosen rows is a share of each label
    extra = Counter(x for k, v in rows if k in chosen for x in v)
    share = (120 - len(chosen)) / (700 - len(chosen))
    assert all(abs(part[x] - extra[x] - (full[x] - extra[x]) * share) <= 3 for x in full)
    assert subset(rows, 900).keys() == dict(rows).keys()
    with pytest.raises(ValueError):
        subset(rows, 0)


def test_places_need_no_large_window(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 7 == 0 else "hot" if i % 7 < 5 else f"g{i % 7}", rng.choice([5, -9]) if i % 50 == 0 else rng.randrange(-(2**63), 2**63)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, h long")
    want = {}
    for g in {r[1] for r in rows}:
        of = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        want |= {r[0]: (i, len(of)) for i, r in enumerate(of)}
    for size in (40, ranks.ROWS):
        assert {r["id"]: (r["place"], r["members"]) for r in ranks.placed(df, ["g"], "h", ["id"], size).collect()} == want
    everything = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r["id"]: r["place"] for r in ranks.placed(df, [], "h", ["id"], 100).collect()} == everything
    # no slice is much larger than asked for
    sizes = df.withColumn("s", F.floor((F.col("h") / 2.0**64 + 0.5) * 30)).where("g = 'hot'").groupBy("s").count().agg(F.max("count")).first()[0]
    assert sizes < 200


def test_batches_of_an_epoch(spark):
    lengths = [20, 200, 300, 500, 700, 900, 1100, 1800, 2500] * 7
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")

    def batches(epoch, seed=9):
        out = defaultdict(list)
        for r in split.token_batches(df, "id", "n", [256, 512, 1024, 2048], 8, seed, epoch).collect():
            out[r["batch"]].append(r)
        return out

    first = batches(0)
    assert sorted(r["id"] for b in first.values() for r in b) == list(range(63)) and sorted(first) == list(range(8))
    for b in first.values():
        assert sorted(r["place"] for r in b) == list(range(len(b))) and all(r["rows"] == len(b) and r["loss_scale"] == len(b) / 8 for r in b)
        bucket = {sum(e <= r["n"] for e in (256, 512, 1024, 2048)) for r in b}
        assert b[0]["bucket"] == -1 or bucket == {b[0]["bucket"]} and len(b) == 8
    assert sum(len(b) < 8 for b in first.values()) == 1

    def order(b):
        return [r["id"] for k in sorted(b) for r in sorted(b[k], key=lambda r: r["place"])]

    assert order(first) == order(batches(0)) != order(batches(1)) and order(batches(1)) == order(batches(0, seed=10))
    with pytest.raises(Exception, match="positive"):
        split.token_batches(df.union(spark.createDataFrame([(99, 0)], df.schema)), "id", "n", [256], 8).collect()
    with pytest.raises(ValueError):
        split.token_batches(df, "id", "n", [512, 256], 8)


def test_padding_by_counts_of_lengths(spark):
    rng = random.Random(2)
    for n in (0, 1, 7, 64, 203):
        lengths = [rng.choice([3, 8, 9, 700, 5000]) for _ in range(n)]
        got = stats.padding(spark.createDataFrame([(x,) for x in [*lengths, None]], "n int"), "n", 4).first()
        kept = sorted(min(x, 2048) for x in lengths)
        padded = sum(len(b) * min(-(-b[-1] // 8) * 8, 2048) for b in (kept[i : i + 4] for i in range(0, n, 4)))
        assert (got["batches"], got["used"] or 0, got["padded"] or 0) == (-(-n // 4), sum(kept), padded)
