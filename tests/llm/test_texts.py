"""Brute-force comparisons of the text operators."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import components, decontaminate, jaccard_join, line_dedup, textops, url_filter

DOCS = "doc_id long, text string, lang string, n_words long, lines_removed long, component_id long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(texts: dict, n, t):
    """Smallest id of each link component."""
    sets, up = {i: shingles(x, n) for i, x in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def varied(rng, count=120, words=60):
    """Groups of near copies with a few changed words, and strangers."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = {}
    for i in range(count):
        if i % 3 == 0:
            text = [f"x{rng.randrange(4000)}" for _ in range(rng.randrange(1, words))]
        else:
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"y{rng.randrange(300)}"
        out[i] = " ".join(text)
    return out


@pytest.mark.parametrize("region", [1500, 16])
def test_jaccard_join(spark, region):
    texts = varied(random.Random(5)) | {900: None, 901: "", 902: " \n", 903: "One", 904: "one", 905: "a b c", 906: "A\tb\nc", 907: "long " * 30_000}
    rows = [(i, t, "x", 1, 1, 1) for i, t in texts.items()]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in jaccard_join.near_classes(df, 4, Fraction(85, 100), region).collect()}
    want = classes(texts, 4, Fraction(85, 100))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(texts[i], 4)) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 20


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_classes(spark.createDataFrame([], DOCS)).collect() == []
    one = jaccard_join.near_classes(spark.createDataFrame([(None, "a b c d e f", "x", 1, 1, 1), (3, "a b c d e f", "x", 1, 1, 1), (3, "", "x", 1, 1, 1)], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in one) == [("3", 3), ("3", 3), ("None", 3)]


def test_voronoi_regions_join_exactly():
    rng = random.Random(3)
    texts = varied(rng, 900, 80)
    sets = [np.array(sorted({hash(s) & 0xFFFFFFFF for s in shingles(t, 3)}), dtype=np.uint64) for t in texts.values()]
    t = Fraction(7, 10)
    join = jaccard_join.RegionJoin(sets, t, np.zeros(len(sets)), False)
    join.join(np.arange(len(sets)))
    assert join.deepest >= 1 and join.edges, "the region was not cut into cells"
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    plain = [set(s.tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            if len(plain[a] & plain[b]) >= t * len(plain[a] | plain[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert [join.forest.root(i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("count", [4, 7, 15, 60])
def test_small_regions_pass_through_cells(count):
    """Two families of near copies, and strangers: their links come from cells within cells."""
    rng = random.Random(count)
    families = [[rng.randrange(10**9) for _ in range(200)] for _ in range(2)]
    sets = []
    for i in range(count):
        items = list(families[i % 3]) if i % 3 < 2 else [rng.randrange(10**9) for _ in range(50)]
        for _ in range(rng.randrange(12)):
            items[rng.randrange(len(items))] = rng.randrange(10**9)
        sets.append(np.unique(np.array(items, dtype=np.uint64)))
    t = Fraction(85, 100)
    join = jaccard_join.RegionJoin(sets, t, np.zeros(count), False)
    join.join(np.arange(count))
    assert join.deepest >= 1
    plain, up = [set(x.tolist()) for x in sets], jaccard_join._Forest(count)
    for a in range(count):
        for b in range(a):
            if len(plain[a] & plain[b]) >= t * len(plain[a] | plain[b]):
                up.link(a, b)
    assert [join.forest.root(i) for i in range(count)] == [up.root(i) for i in range(count)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def lines_kept(rows, threshold, least):
    """(id, kept lines) by comparing every line with all earlier ones."""

    def near(a, b):
        if abs(len(a) - len(b)) > threshold:
            return False
        a, b = (x[len(os.path.commonprefix([a, b])) :] for x in (a, b))
        a, b = (x[len(os.path.commonprefix([a[::-1], b[::-1]])) :] for x in (a[::-1], b[::-1]))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] <= threshold

    seen, out = [], {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again = any(line == s or min(len(line), len(s)) >= least and near(line, s) for s in seen)
                seen.append(line)
                if again:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("threshold", [1, 2])
def test_line_dedup(spark, threshold):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.randrange(10, 30))) for _ in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 3)):
                line[rng.randrange(len(line))] = rng.choice("abxy")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "short"), (54, "q" * 70_000), (55, "q" * 70_001 + "\nshort")]
    df = spark.createDataFrame([(i, t, "x", 1, 1, 1) for i, t in rows], DOCS).repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, threshold, 12, keep_empty=True).collect()}
    want = lines_kept(rows, threshold, 12)
    assert got == want
    assert sum(want[i] != t for i, t in rows) > 10
    left = {r["doc_id"] for r in line_dedup.dedup(df, threshold, 12).collect()}
    assert left == {i for i, t in rows if want[i] == t or want[i].strip()}


def made_rows(spark, at_least=0):
    """The largest number of rows that a join of the plans run since the last call made."""
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsList()
    most = 0
    for i in range(ran.size()):
        run = ran.apply(i)
        if run.executionId() <= at_least:
            continue
        values = store.executionMetrics(run.executionId())
        nodes = store.planGraph(run.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            for m in range(node.metrics().size()) if "Join" in node.name() else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, max([at_least, *[ran.apply(i).executionId() for i in range(ran.size())]])


def test_hot_segments_make_rows_in_proportion(spark):
    """5,000 different lines that share their first half, and 1,000 that differ by a few edits of one line."""
    rng = random.Random(8)
    letters = "abcdefghij "
    base = "".join(rng.choice(letters) for _ in range(60))
    rows = [(i, "A common beginning that many lines share: " + "".join(rng.choice(letters) for _ in range(40))) for i in range(5000)]
    for i in range(1000):
        line = list(base)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(line))
            line[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        rows.append((10_000 + i, "".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, before = made_rows(spark)
    got = {r["doc_id"] for r in line_dedup.dedup(docs).select("doc_id").collect()}
    most, _ = made_rows(spark, before)
    a, b = docs.alias("a"), docs.alias("b")
    late = a.join(b, (F.col("a.doc_id") > F.col("b.doc_id")) & (F.levenshtein("a.text", "b.text", 2) >= 0)).select("a.doc_id").distinct()
    assert got == {i for i, _ in rows} - {r["doc_id"] for r in late.collect()}
    assert 0 < most < 100 * len(rows), "a hot segment makes pairs"


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_banded_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 25)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(0, len(b) + 1)
            b[i : i + rng.randrange(0, 2)] = rng.choice(["", "a", "é"])
        rows.append(tuple(sorted((a, "".join(b)), key=len, reverse=True)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        got = df.select(F.levenshtein("a", "b").alias("l"), line_dedup.banded_distance(F.col("a"), F.col("b"), t).alias("d"), line_dedup.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        assert all((r["l"] <= t) == r["w"] and (r["d"] == r["l"] if r["l"] <= t else r["d"] > t) for r in got)


def contained(docs, items, size):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = defaultdict(set)
    for k, t in items:
        w = word.findall(lower(t or ""))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[i : i + size])].add(k)
    out = {}
    for d, t in docs:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for i in range(len(w)):
            for n in range(1, size + 1):
                g = tuple(w[i : i + n])
                if len(g) == n and g in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[g]
        out[d] = (len(w), len(hit), sorted(str(k) for k in found if k is not None))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, block):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "x-y", "THE"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 14])))) for i in range(12)] + [(90, None), (91, "  "), (None, "secret words here"), (0, "again some other words")]
    docs = [(i, " ".join([rng.choice(words) for _ in range(rng.randrange(0, 12))] + (rng.choice(items)[1] or "").upper().split() + [rng.choice(words)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a secret. Words, HERE! b"), (103, "secret words " * 20_000 + "here")]
    d = spark.createDataFrame([(i, t, "x", 1, 1, 1) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(d, b, 10, block=block).select("doc_id", "n_words", decontaminate.hit_words().alias("hit"), "items", "text")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one block of windows at a time
    rows = {r["doc_id"]: (r["n_words"], r["hit"], r["items"]) for r in got.collect()}
    want = contained(docs, items, 10)
    assert rows == want and sum(v[1] > 0 for v in want.values()) > 20
    clean = decontaminate.clean(d, b)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == {i for i, v in want.items() if not v[1]}


def test_decontamination_of_nothing(spark):
    d, b = spark.createDataFrame([(1, "a b", "x", 1, 1, 1)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(d, b).first()["items"] == []
    assert decontaminate.mark(d.limit(0), b).collect() == []


def test_url_rules(spark):
    rules = url_filter.rule_table(spark, [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("allow", "com/de/"), ("block", "Net")])
    urls = {
        "http://a.EXAMPLE.org/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "x://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com/DE/": ("a.com", "/DE/", None, "allow"),
        "http://a.net/": ("a.net", "/", "Net", "block"),
        "no scheme": ("", "", None, "allow"),
        "http://u@h.org:80/": ("u@h.org:80", "/", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "h://" + "a." * 5000 + "org/" + "p" * 50_000: ("a." * 5000 + "org", "/" + "p" * 50_000, "org/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, next(iter(urls)), "h", "r")], "page_id long, url string, host string, rule string")
    got = url_filter.judge(df, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]
    assert url_filter.judge(df.limit(0), rules).collect() == []
    none = url_filter.judge(df, url_filter.rule_table(spark, [("allow", "x/")]).limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"}


def test_words_of_long_texts():
    texts = ["a bc  d", "", "x" * 3_000_000 + " y", "é ü\tz" * 200_000, "q"]
    data, off = textops.byte_view(pa.array(texts))
    h, s, e, at = textops.words(data, off, textops.SPACE)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(s, e)] == [w for t in texts for w in t.split()]
    assert list(np.diff(at)) == [len(t.split()) for t in texts]
    by_word = defaultdict(set)
    for w, x in zip((w for t in texts for w in t.split()), h.tolist()):
        by_word[w].add(x)
    assert all(len(v) == 1 for v in by_word.values()) and len({x for v in by_word.values() for x in v}) == len(by_word)


def test_item_digests(spark):
    from sievework.llm import queries

    r = {x["doc_id"]: x for x in queries.op4_decontamination(spark, "/root/testdata/sf0.001").collect()}
    clean = next(x for x in r.values() if not x["contaminated"])
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest() and any(x["contaminated"] for x in r.values())


def thue_morse(k):
    """Two words of 2**k letters that collide under every polynomial hash modulo 2**64, for k of 10 or more."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("k", [10, 12, 16])
def test_words_that_defeat_polynomials(spark, k):
    a, b = thue_morse(k)
    data, off = textops.byte_view(pa.array([f"{a} {b}", b]))
    h, *_ = textops.words(data, off, textops.SPACE)
    assert h[0] != h[1] and h[1] == h[2]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_classes(docs, 4, Fraction(85, 100)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([("i", b)], "item_id string, text string")
    marked = decontaminate.mark(docs, items).collect()
    assert {r["doc_id"]: list(r["items"]) for r in marked} == {1: [], 2: ["i"], 3: []}


def test_many_url_rules(spark):
    """Rules of many shapes make no larger a plan, and equal prefixes of digests are told apart."""
    rng = np.random.default_rng(3)
    hosts = [".".join(rng.choice(["a", "bb", "c"], size=n)) for n in (1, 2, 3, 4) for _ in range(5)]
    rules = sorted({(str(rng.choice(["allow", "block"])), str(rng.choice(hosts)) + "/" + "p" * int(rng.integers(0, 60))) for _ in range(200)})
    table = url_filter.rule_table(spark, rules)
    urls = [(i, f"http://{'x.' * int(rng.integers(0, 2))}{rng.choice(hosts)}/{'p' * int(rng.integers(0, 70))}?q") for i in range(150)]
    df = spark.createDataFrame(urls, "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, table).collect()}
    used = next(r for r, _ in got.values() if r)
    clash = table.withColumn("prefix", F.lit(table.where(F.col("rule") == used).first()["prefix"]))
    assert {r["rule"] for r in url_filter.judge(df, clash).collect()} == {used, None}  # all rules meet its expression
    for i, url in urls:
        host, path = url.split("://")[1].split("?")[0].split("/", 1)
        fits = []
        for verdict, rule in rules:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p):
                fits.append((len(h) + 1 + len(p), verdict, rule))
        best = max(fits, default=(0, "allow", None))
        assert got[i] == (best[2], best[1])
