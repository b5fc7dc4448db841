"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line that is not blank repeats an earlier one if both are equal, or if both have
``min_chars`` characters at least and their edit distance is at most ``threshold``;
earlier means a smaller (doc_id, text hash, line number) of its first occurrence.
Repeating lines are removed, and so are documents of which nothing is left.
Shorter lines repeat equal ones only, because two edits make another statement of
a short line.

Equal lines are found by a 128-bit hash. Every distinct line is split into
threshold + 1 segments; of two lines within the threshold one segment of the
shorter occurs in the longer unchanged, at a position that the lengths and the
segment's number bound. So segments are indexed by (length, number, text), the
bounded substrings of every line probe this index, and candidates are verified
by a banded bit-parallel edit distance on what common prefixes and suffixes
leave.

A line needs one earlier partner, not all of them, so a key that many lines share
makes no pairs of all of them: such lines are compared with a pivot, and those
within the threshold meet as equal strings after edits that the pivot tells
(``pairs_of_groups``). That takes rows in proportion to the lines, times the
logarithm of the group.

Nulls and edge cases: null texts and texts without lines are kept as they are;
null ids come first; rows that are equal in id and text are one document and get
the same result; blank lines always stay; an empty table gives an empty result;
other columns are kept, but for ``lines_removed``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

THRESHOLD, MIN_CHARS = 2, 32
#: Hashes of lines or keys that are still sent to every task; more are joined by shuffling.
SENT = 500_000
#: Lines of a key that are compared with each other; larger groups meet by their edits of a pivot.
FEW = 16
_LOC = ["doc_id", "tkey", "pos"]


def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 0, size) of part i when ``length`` is cut into ``parts``; the last ones are longer."""
    base = F.floor(length / parts).cast("int")
    first_longer = parts - (length - base * parts)
    return (i * base + F.greatest(i - first_longer, F.lit(0))).cast("int"), (base + (i >= first_longer).cast("int")).cast("int")


def roles(threshold: int) -> list[tuple[int, int, int]]:
    """(length less, segment, shift) of every key of a line; the first threshold + 1 are those of the index."""
    k = threshold
    probes = [(d, i, s) for d in range(k + 1) for i in range(k + 1) for s in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]
    return [(0, i, 0) for i in range(k + 1)] + [r for r in probes if r[0] or r[2]]


def keys(line: Column, length: Column, threshold: int) -> list[Column]:
    """The keys of a line in the order of roles(); one beyond a very short line's bounds is of no use, but does no harm."""
    out = []
    for less, i, shift in roles(threshold):
        s, n = segment(length - less, F.lit(i), threshold + 1)
        out.append(F.xxhash64(length - less, F.lit(i), F.substring(line, s + (shift + 1), n)))
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, pos, line, chars, h1, h2 of every line that is not blank."""
    split = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("chars")))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.posexplode(split).alias("pos", "l")).select("doc_id", "tkey", "pos", "l.line", "l.chars")
    real = keyed.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return real.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def common_prefix(a: Column, b: Column, length: Column, bits: int = 31) -> Column:
    """Characters that a and b share at their start, by bisection; length: of the shorter."""

    def longer(n: Column, step: Column) -> Column:
        more = n + step
        return F.when((more <= length) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), more).otherwise(n)

    steps = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), longer)


def banded_distance(p: Column, t: Column, threshold: int) -> Column:
    """Edit distance of strings p and t, |p| >= |t|, if it is at most ``threshold``; else a larger number.

    One machine word holds the vertical differences of the band's rows; bit b of
    column j is row j - pad + b, and the score follows the last cell's diagonal.
    """
    pad = threshold + 2
    width = pad + threshold + 1
    full = (1 << width) - 1
    chars, m, n = F.split(p, ""), F.length(p), F.length(t)
    other = F.split(t, "")
    last = (m - n + pad).cast("int")

    def step(acc: Column, j: Column) -> Column:
        c = F.element_at(other, j)
        match = F.lit(0).cast("long")
        for b in range(width):
            i = j - pad + b
            match = match + F.when((i >= 1) & (i <= m) & (F.get(chars, i - 1) == c), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
        vp, vn = acc["vp"], acc["vn"]
        x = F.struct(match.alias("m"), vp.alias("vp"), vn.alias("vn"))
        # each part is named in a struct of its own, so that it is evaluated once
        d0 = F.transform(F.array(x), lambda v: F.struct(v["vp"].alias("vp"), v["vn"].alias("vn"), ((((v["m"].bitwiseAND(v["vp"])) + v["vp"]).bitwiseXOR(v["vp"])).bitwiseOR(v["m"]).bitwiseOR(v["vn"])).bitwiseAND(F.lit(full).cast("long")).alias("d0")))
        h = F.transform(d0, lambda v: F.struct(v["d0"].alias("d0"), v["vn"].bitwiseOR(F.bitwise_not(v["d0"].bitwiseOR(v["vp"]))).bitwiseAND(F.lit(full).cast("long")).alias("hp"), v["d0"].bitwiseAND(v["vp"]).alias("hn")))
        out = F.transform(
            h,
            lambda v: F.struct(
                v["hn"].bitwiseOR(F.bitwise_not(F.shiftright(v["d0"], 1).bitwiseOR(v["hp"]))).bitwiseAND(F.lit(full).cast("long")).alias("vp"),
                F.shiftright(v["d0"], 1).bitwiseAND(v["hp"]).alias("vn"),
                (acc["score"] + 1 - F.getbit(v["d0"], last).cast("int")).alias("score"),
            ),
        )
        return F.get(out, F.lit(0))

    start = F.struct(F.lit(full & ~((1 << pad) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), (m - n).cast("int").alias("score"))
    swept = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["score"])
    # one of the threshold + 1 parts of the shorter string is in the other one, nearly at its place
    kept = F.lit(False)
    for i in range(threshold + 1):
        s, size = segment(n, F.lit(i), threshold + 1)
        low = F.greatest(s - threshold, F.lit(0))
        kept = kept | F.substring(p, low + 1, s + size + threshold - low).contains(F.substring(t, s + 1, size))
    # of strings that differ at both ends, an edit mends one end at most, and two leave what is between them
    ways, between = ((1, 1), (1, 0), (0, 1)), F.lit(False)
    for i, i2 in ways:
        for j, j2 in ways:
            between = between | ((m - i - j == n - i2 - j2) & (F.substring(p, F.lit(i + 1), m - i - j) == F.substring(t, F.lit(i2 + 1), n - i2 - j2)))
    ends = F.when((m > 1) & (F.substring(p, 1, 1) != F.substring(t, 1, 1)) & (F.substring(p, -1, 1) != F.substring(t, -1, 1)), F.when((n > 2) & ~between, 3).otherwise(2)).otherwise(0)
    return F.when((m - n > threshold) | (ends > threshold) | ~kept, threshold + 1).when(n == 0, m).otherwise(swept)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of a and b is at most ``threshold``; a is not shorter."""
    la, lb = F.length(a), F.length(b)
    s = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), la.alias("la"), lb.alias("lb"))), lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), common_prefix(v["a"], v["b"], v["lb"]).alias("c"), v["la"].alias("la"), v["lb"].alias("lb")))
    cut = F.transform(s, lambda v: F.struct(F.substring(v["a"], v["c"] + 1, v["la"]).alias("a"), F.substring(v["b"], v["c"] + 1, v["lb"]).alias("b")))
    back = F.transform(cut, lambda v: F.struct(F.reverse(v["a"]).alias("a"), F.reverse(v["b"]).alias("b")))
    tail = F.transform(back, lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), common_prefix(v["a"], v["b"], F.length(v["b"])).alias("c")))
    core = F.transform(tail, lambda v: F.struct(F.substring(v["a"], v["c"] + 1, F.length(v["a"])).alias("a"), F.substring(v["b"], v["c"] + 1, F.length(v["b"])).alias("b")))
    return F.get(F.transform(core, lambda v: banded_distance(v["a"], v["b"], threshold)), F.lit(0)) <= threshold


def edited(layer: DataFrame, most_used: int) -> DataFrame:
    """The strings that one edit makes of ``text`` where it leaves ``pivot`` (behind ``p`` characters) and that agree with the pivot there."""
    text, p = F.col("text"), F.col("p")
    head, here = F.substring(F.col("pivot"), F.lit(1), p), F.substring(F.col("pivot"), p + 1, F.lit(1))
    tail = lambda n: F.substring(text, p + 1 + n, F.length(text))
    inside, more = p < F.length("text"), p < F.length("pivot")
    made = F.array(F.when(inside & more, F.concat(head, here, tail(1))), F.when(inside, F.concat(head, tail(1))), F.when(more, F.concat(head, here, tail(0))))
    return led(layer.withColumn("used", F.col("used") + 2).withColumn("text", F.explode(made)).where("text is not null"), most_used)


def led(layer: DataFrame, most_used: int) -> DataFrame:
    """With p, the number of characters for which ``text`` and ``pivot`` agree, where another edit is left."""
    return layer.withColumn("p", F.when(F.col("used") + 2 <= most_used, common_prefix(F.col("text"), F.col("pivot"), F.least(F.length("text"), F.length("pivot")))))


def pairs_of_groups(members: DataFrame, threshold: int) -> list[DataFrame]:
    """Stored pairs (a, b: h1) of the lines of each group: with each line that has an earlier one within the threshold, such a one.

    members: g, h1, loc, used, text. Of two different strings within the threshold,
    the first edit can be made where they part. Let p(x) tell for how long x agrees
    with the group's pivot. If p(x) < p(y), they part where x leaves the pivot, and
    there the edit of x is known from the pivot: ``edited`` makes it. If p is equal
    and the next character too, they are in a smaller group with a pivot of its own.
    If only p is equal, strings with other next characters than the most frequent one
    are edited towards that and join its group; among themselves, what follows, with
    and without the next character, makes a group with an edit less. So lines within the threshold meet as equal strings, of which
    the earliest is enough for all others. ``used`` counts half edits: what both
    strings of a pair have used is what the pair has.
    """
    most_used, spark, found = 2 * threshold, members.sparkSession, []
    now = storage.stored(members, "line-group")
    while True:
        size = now.groupBy("g").agg(
            F.count("*").alias("n"), F.min("h1").alias("least"), F.max("h1").alias("most"), F.min("used").alias("low"), F.min_by("text", F.xxhash64("g", "text")).alias("pivot")
        )
        size = size.where(F.expr(f"least <> most and 2 * low + 2 <= {most_used}")).select("g", "n", "low", "pivot")
        live = storage.stored(led(now.join(size, "g").where(F.col("used") + F.col("low") + 2 <= most_used).drop("low"), most_used), "line-live")
        storage.dropped(spark, now)
        if not live.head(1):
            storage.dropped(spark, live)
            return found
        few, hot = live.where(F.col("n") <= FEW), live.where(F.col("n") > FEW)
        side = few.select("g", F.col("h1").alias("b"), F.col("used").alias("also"))
        met = few.select("g", F.col("h1").alias("a"), "used").join(side, "g").where((F.col("a") < F.col("b")) & (F.col("used") + F.col("also") <= most_used)).select("a", "b")
        layers = [hot]
        for _ in range(threshold):
            layers.append(edited(layers[-1].where(F.col("used") + 2 <= most_used), most_used))
        every = layers[0]
        for layer in layers[1:]:
            every = every.union(layer)
        every = storage.stored(every.select("g", "h1", "loc", "used", "text", "p", (F.col("text") != F.col("pivot")).alias("parts")), "line-layers")
        text, p = F.col("text"), F.col("p")
        apart = every.where(F.col("parts") & (F.col("used") + 2 <= most_used))
        after = F.substring(text, p + 1, F.lit(1))
        child = F.xxhash64("g", "p", after).alias("g")
        usual = apart.groupBy("g", "p", after.alias("next")).agg(F.count("*").alias("n")).groupBy("g", "p").agg(F.max_by("next", F.struct("n", "next")).alias("usual"), F.count("*").alias("ways")).where("ways > 1")
        forked = apart.join(usual.drop("ways"), ["g", "p"])
        other, tail = forked.where(after != F.col("usual")), F.substring(text, p + 2, F.length(text))
        behind = F.array(F.substring(text, p + 1, F.length(text)), F.when(p < F.length(text), tail))
        loose = other.select(F.xxhash64("g", "p", F.lit("*")).alias("g"), "h1", "loc", (F.col("used") + 1).alias("used"), F.explode(behind).alias("text")).where("text is not null")
        head, here = F.substring(text, F.lit(1), p), F.col("usual")
        towards = F.array(F.concat(head, here, tail), F.concat(head, tail), F.concat(head, here, F.substring(text, p + 1, F.length(text))))
        moved = other.select(F.xxhash64("g", "p", "usual").alias("g"), "h1", "loc", (F.col("used") + 2).alias("used"), F.explode(F.array_distinct(towards)).alias("text"))
        met_there = forked.where(after == F.col("usual")).select(child, "h1", "loc", "used", "text")
        equal = every.select("g", "h1", "loc", "used", "text").union(loose).union(moved).union(met_there)
        equal = equal.select(F.xxhash64("g", "text").alias("e"), F.xxhash64(F.lit(1), "g", "text").alias("e2"), "h1", "loc", "used")
        equal = storage.stored(equal, "line-equal")
        first = [F.min(F.when(F.col("used") <= most_used - u, F.struct("loc", "h1"))).alias(f"first{u}") for u in range(most_used + 1)]
        best = equal.groupBy("e", "e2").agg(*first, F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most")
        one = F.coalesce(*[F.when(F.col("used") == u, F.col(f"first{u}")["h1"]) for u in range(most_used + 1)])
        met_equal = equal.join(best, ["e", "e2"]).select(F.col("h1").alias("a"), one.alias("b")).where("a <> b").distinct()
        found.append(storage.stored(met.union(met_equal), "line-pairs"))
        same = apart.select(child, "h1", "loc", "used", "text")
        now = storage.stored(same.union(loose.where(F.col("used") + 3 <= most_used)).union(moved.where(F.col("used") + 2 <= most_used)), "line-group")
        storage.dropped(spark, live, every, equal)


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """h1, h2, loc of the later line of each pair (a, b: h1) within the threshold."""
    side = lambda x: texts.select(F.col("h1").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("h2", "loc", "line", "chars")])
    met = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    # the longer line comes first
    swap = F.col("a_chars") < F.col("b_chars")
    near = met.where(within(F.when(swap, F.col("b_line")).otherwise(F.col("a_line")), F.when(swap, F.col("a_line")).otherwise(F.col("b_line")), threshold))
    a, b = (F.struct(F.col(f"{x}_loc").alias("loc"), F.col(x).alias("h1"), F.col(f"{x}_h2").alias("h2")) for x in "ab")
    return near.select(F.greatest(a, b).alias("late")).select("late.h1", "late.h2", "late.loc").distinct()


def similar_lines(firsts: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """h1, h2, loc of distinct lines with an earlier line within the threshold."""
    entries = firsts.select("h1", F.posexplode("keys").alias("role", "key"))
    grouped = entries.groupBy("key").agg(F.count("*").alias("n"), F.max((F.col("role") <= threshold).cast("int")).alias("indexed"), F.min("h1").alias("a"), F.max("h1").alias("b"))
    groups = storage.stored(grouped.where("n > 1 and indexed = 1 and a <> b").select("key", "n", "a", "b"), "line-groups")
    wide = groups.where("n > 2").select("key", "n", "a")
    few = wide.count() <= SENT
    members = storage.stored(entries.join(F.broadcast(wide) if few else wide, "key").select("key", "n", "a", "h1", (F.col("role") <= threshold).alias("indexed")), "line-members")
    ids = storage.stored(groups.where("n = 2").select(F.explode(F.array("a", "b")).alias("h1")).union(members.select("h1")).distinct(), "line-ids")
    small = ids.count() <= SENT
    found = lines_of(docs).join(F.broadcast(ids) if small else ids, "h1", "left_semi")
    texts = storage.stored(found.groupBy("h1", "h2").agg(F.min(F.struct(*_LOC)).alias("loc"), F.first("line").alias("line"), F.first("chars").alias("chars")), "line-texts")
    side = members.where(F.col("n") <= FEW).select("key", F.col("h1").alias("b"), F.col("indexed").alias("also"))
    met = members.where(F.col("n") <= FEW).select("key", F.col("h1").alias("a"), "indexed").join(side, "key").where("a < b and (indexed or also)").select("a", "b")
    # groups with the same least line are mostly those of one line's segments: they are one group from here on
    hot = members.where(F.col("n") > FEW).select(F.col("a").alias("g"), "h1").distinct().join(texts.select("h1", "loc", F.col("line").alias("text")), "h1")
    more = pairs_of_groups(hot.select("g", "h1", "loc", F.lit(0).alias("used"), "text"), threshold)
    pairs = groups.where("n = 2").select("a", "b").union(met)
    for part in more:
        pairs = pairs.union(part)
    late = storage.stored(verified(pairs, texts, threshold), "line-near")
    storage.dropped(docs.sparkSession, groups, members, ids, texts, *more)
    return late


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, tkey and pos of every line that repeats an earlier one."""
    lines = lines_of(docs)
    line, chars = F.col("line"), F.col("chars")
    keyed = lines.select("h1", "h2", F.struct(*_LOC).alias("loc"), "chars", F.array(*keys(line, chars, threshold)).alias("keys"))
    firsts = keyed.groupBy("h1", "h2").agg(F.min("loc").alias("loc"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("keys").alias("keys"))
    firsts = storage.stored(firsts, "lines")
    near = similar_lines(firsts.where(F.col("chars") >= min_chars), docs, threshold)
    copied = firsts.where("copies > 1").select("h1", "h2", F.col("loc").alias("first"))
    copies = lines.select("h1", "h2", F.struct(*_LOC).alias("loc")).join(copied, ["h1", "h2"]).where("loc <> first").select("loc.*")
    gone = storage.stored(copies.unionByName(near.select("loc.*")), "repeated")
    storage.dropped(docs.sparkSession, firsts, near)
    return gone


def without(text: Column, gone: Column) -> Column:
    """text without the lines at the positions ``gone``, in time linear in its lines."""
    one = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))
    left = F.transform(one, lambda v: F.struct(v["lines"].alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(v["lines"]) - 1), v["gone"]).alias("kept")))
    return F.get(F.transform(left, lambda v: F.array_join(F.transform(v["kept"], lambda i: F.get(v["lines"], i)), "\n")), F.lit(0))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, keep_empty: bool = False) -> DataFrame:
    """docs without repeating lines, plus lines_removed; documents of which nothing is left go unless ``keep_empty``."""
    docs = docs.drop("lines_removed")
    gone = repeated_lines(docs.select("doc_id", "text"), threshold, min_chars).groupBy("doc_id", "tkey").agg(F.collect_set("pos").alias("gone"))
    keyed = docs.withColumn("__tkey", F.xxhash64("text")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.__tkey") == F.col("g.tkey"))
    met = keyed.join(gone.alias("g"), on, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("g.gone").alias("__gone"))
    out = met.withColumn("lines_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    out = out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("__gone"))))
    if not keep_empty:
        out = out.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.drop("__gone")
