"""Brute-force comparisons of vectors, conversations and runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from sievework.llm import conversation_repair, lattice, runs

# --- periodic runs


def plain_runs(x, times=4, least=6):
    out = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
    for _ in range(rng.randrange(4)):
        if len(x) > 8:
            a, p, n = rng.randrange(len(x)), rng.randrange(1, 12), rng.randrange(1, 60)
            for i in range(a, min(len(x), a + n)):
                x[i] = x[a + (i - a) % p]
    return x


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        x = sequence(rng)
        assert runs.runs_of_words(x) == plain_runs(x), x
        if x:  # without the cuts at rare words
            assert sorted(runs.runs_of(np.array(x))) == sorted(plain_runs(x)), x
    for times, least in ((2, 2), (3, 4)):
        for _ in range(500):
            x = sequence(rng)
            assert runs.runs_of_words(x, times, least) == plain_runs(x, times, least), (times, x)


def test_factors_are_longest_earlier_strings():
    rng = random.Random(4)
    for _ in range(300):
        x = sequence(rng)
        at = 0
        for begin, size, earlier in runs.factors(np.array(x, dtype=np.int64)):
            assert begin == at
            best = max((next((k for k in range(len(x) - begin + 1) if begin + k == len(x) or x[b + k] != x[begin + k]), 0) for b in range(begin)), default=0)
            assert size == max(best, 1) and (earlier >= 0) == (best > 0)
            if earlier >= 0:
                assert earlier < begin and all(x[earlier + k] == x[begin + k] for k in range(size))
            at += size
        assert at == len(x)


def test_long_texts_are_linear():
    import time

    begin = time.perf_counter()
    assert len(runs.runs_of_words([b"a"] * 100_000)) == 1
    assert runs.runs_of_words([i % 9 for i in range(100_000)]) == [(0, 100_000, 9)]
    assert time.perf_counter() - begin < 30


def test_run_query_rows(spark):
    rng = random.Random(8)
    texts = {i: " ".join(f"w{c}" for c in sequence(rng)) for i in range(150)}
    texts |= {150: None, 151: "", 152: " \t\n ", 153: "a " * 5000, 154: "a b " * 7, 155: "A a A a A a A a"}
    rows = [(i, t, "clash", 1) for i, t in texts.items()] + [(3, texts[3], "again", 2), (None, "x " * 8, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, period int").repartition(5)
    got = runs.detect(df, runs.periodic_text, keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", (texts[r["doc_id"]] if r["doc_id"] is not None else "x " * 8) or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        gone = {i for s, e, q in found for i in range(s + q, e)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["n_runs"] == len(found) and r["collapsed"] == kept and r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
        best = min(found, key=lambda f: (-((f[1] - f[0]) * 10**12 // f[2]), f[0], f[2]), default=None)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]))
    assert runs.detect(df.limit(0)).collect() == []


# --- conversations


def plain_cheapest(rows):
    """Least (cost, audit) of rows (initial, has to go, truncated), by relaxing until nothing changes; audits are strings here."""
    best = {(0, ""): (0, "")}  # (row, last initial)
    while True:
        new = dict(best)
        for (i, last), (cost, audit) in best.items():
            need = "a" if last == "u" else "u"
            ways = [(5, "I", need, i)]
            if i < len(rows):
                initial, must, cut = rows[i]
                ways.append((2, "D", last, i + 1))
                if not must:
                    ways.append((1 + 5 * cut, "R", need, i + 1))
                    if initial == need or initial == "s" and last == "":
                        ways.append((5 * cut, "K", initial, i + 1))
            for more, letter, to, at in ways:
                if cost + more <= 2 * len(rows) + 10 and (cost + more, audit + letter) < new.get((at, to), (10**9, "")):
                    new[at, to] = (cost + more, audit + letter)
        if new == best:
            return min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)
        best = new


def test_cheapest_edits():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(12)))
        rows = [("?" if c == "x" else c.lower(), c == "x", c.isupper()) for c in codes]
        assert conversation_repair._search(codes) == plain_cheapest(rows), codes
    codes = "".join(rng.choice("uauax") for _ in range(3000))
    cost, audit = conversation_repair.cheapest(codes)
    assert cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit) and len(audit.replace("I", "")) == 3000


def plain_repair(rows):
    """The contract, row by row, for one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
    out, at = [], 0
    for letter in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((role, ""))
            continue
        if letter != "D":
            out.append((rows[at][1] if letter == "K" else role, rows[at][2]))
        at += 1
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }, out


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))


def test_damaged_conversations_are_repaired(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut", "So?  \n", None, "", "\t ", " ", "z" * 3000 + "."])))
    rows += [(500, 0, "user", "One."), (500, 0, "user", "One.")] + [(501, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(700)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, place string, cost int").repartition(7)
    damaged = list(plain_damage(rows))
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repair(conversation_repair.damaged(df), df.select("conv_id")).collect()}
    texts: dict = {}
    for r in conversation_repair.repair(conversation_repair.damaged(df), keep_rows=True).orderBy("conv_id", "place").collect():
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        if conv == 501:
            assert r["audit"].replace("I", "").count("D") < 150
            continue
        want, out = plain_repair([x[1:] for x in damaged if x[0] == conv])
        assert {k: v for k, v in r.items() if k != "conv_id"} == want, conv
        assert texts.get(conv, []) == out
    assert conversation_repair.repair(conversation_repair.damaged(df.limit(0)), df.limit(0).select("conv_id")).collect() == []


# --- vectors


def plain_links(rows, threshold=0.98):
    """(id, links, component) of each row, by all pairs."""

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ok = [k is not None and usable(v) for _, v, k in rows]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and np.dot(rows[i][1], rows[j][1]) / np.linalg.norm(rows[i][1]) / np.linalg.norm(rows[j][1]) >= threshold] for i in range(len(rows))]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            for j in near[todo.pop()]:
                if part[j] > part[i]:
                    part[j] = part[i]
                    todo.append(j)
    least: dict = {}
    for (id_, _, _), p in zip(rows, part):
        if id_ is not None:
            least[p] = min(least.get(p, id_), id_)
    return sorted(((id_, len(n), least.get(p)) for (id_, _, _), n, p in zip(rows, near, part)), key=str)


def clustered(rng, groups=12, members=25, dim=64, spread=0.012):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(members):
            rows.append([float(x) for x in np.float32((centre + rng.normal(size=dim) * spread) * rng.uniform(0.1, 50))])
    return rows


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * 3
    near = lattice.nearest_point(x)
    assert len(lattice.minimal_vectors()) == 240
    assert np.isin((2 * near) % 2, (0, 1)).all() and ((near.sum(axis=1) % 2) == 0).all() and (np.ptp((2 * near) % 2, axis=1) == 0).all()
    d = ((x - near) ** 2).sum(axis=1)
    assert all((d <= ((x - near - m) ** 2).sum(axis=1) + 1e-9).all() for m in lattice.minimal_vectors())


def test_vectors_link_as_by_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = clustered(rng)
    rows = [(1000 - i, v, int(i % 5 == 0)) for i, v in enumerate(vectors)]
    rows += [(2000 + i, vectors[0], 1) for i in range(40)] + [(9, vectors[7], None), (8, None, 1), (7, [], 1), (6, [0.0] * 64, 1), (5, [1.0, None], 1), (4, [1.0, float("nan")], 1), (3, [float("inf"), 1.0], 1)]
    rows += [(1000, vectors[30], 0), (None, vectors[0], 1), (None, [0.5, 0.25], 3), (50, [-0.0, 1.0], 2), (51, [0.0, 1.0], 2), (52, [0.0, 1e38], 2), (53, [1.0], 2), (54, [2.0], 2), (55, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(6)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    want = plain_links(rows)
    for block in (512, 16):  # hot cells are cut into blocks with the same result
        got = lattice.near_vectors(df, block=block).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, which are the hardest to find."""
    rng = np.random.default_rng(11)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * b
    df = spark.createDataFrame([(2 * i + k, [float(x) for x in v[i]], 0) for i in range(len(a)) for k, v in enumerate((a, b))], "vec_id long, embedding array<double>, label int")
    found = lattice.near_vectors(df).where("n_links > 0").count() / 2
    assert found >= 0.99 * len(a)
