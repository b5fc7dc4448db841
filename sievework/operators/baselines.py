"""Majority and n-gram baselines: hashed ones on pyspark.ml, and multilabel ones over a chosen vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import compact
from sievework.operators import scan
from sievework.session import spread
from sievework.sources.files import stored


def bucket(gram: str, features: int) -> int:
    """Where HashingTF puts a term: 32-bit Murmur3 of its UTF-8 bytes."""
    data, h, full = gram.encode(), 42, 0xFFFFFFFF
    for a in range(0, len(data), 4):
        k = int.from_bytes(data[a : a + 4], "little") * 0xCC9E2D51 & full
        h ^= (k << 15 | k >> 17) * 0x1B873593 & full
        if a + 4 <= len(data):
            h = ((h << 13 | h >> 19) & full) * 5 + 0xE6546B64 & full
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % features


def hashed(docs: DataFrame, features: int = 1 << 14) -> DataFrame:
    """doc_id, label, tf: hashed frequencies of the distinct n-grams of texts (doc_id, text, label), as HashingTF makes them of character_ngrams() of 2 and 3.

    They are counted in slabs where the texts are read, and written once, since the
    fit goes through them several times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def of(grams: list[str]) -> np.ndarray:
            if len(known) > 1 << 20:
                known.clear()
            for g in grams:
                if g not in known:
                    known[g] = bucket(g, features)
            return np.array([known[g] for g in grams], np.int64)

        for batch in batches:
            for part in scan.slabs(batch, SLAB_ROWS):
                slab = Slab(part.column(2))
                single = [(i, t) for i, t in enumerate(part.column(2).to_pylist()) if len(t) == 1]
                cells = [np.array([i for i, _ in single], np.int64) * features + of([t for _, t in single])]
                for n in (2, 3):
                    grams, place, row, _ = slab.counts(n)
                    cells.append(row * features + of(grams)[place])
                cells, tf = np.unique(np.concatenate(cells), return_counts=True)
                row, index = np.divmod(cells, features)
                ends = pa.array(np.searchsorted(row, np.arange(slab.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(index, pa.int32()), pa.array(tf.astype(float)))]
                same = [pa.array(np.full(slab.rows, x, kind)) for x, kind in ((0, np.int8), (features, np.int32))]
                vector = pa.StructArray.from_arrays([*same, *lists], ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], vector], ["doc_id", "label", "tf"])

    rows = spread(docs).select("doc_id", "label", compact(F.col("text")).alias("text"))
    kinds = {f.name: f.dataType for f in rows.schema}
    counted = rows.mapInArrow(run, T.StructType([T.StructField(c, kinds[c]) for c in ("doc_id", "label")] + [T.StructField("tf", VectorUDT.sqlType())]))
    # a vector's stored form is read as a vector
    return stored(counted, "tf", T.StructType([*counted.schema.fields[:2], T.StructField("tf", VectorUDT())]))


def ngram_model(iterations: int = 15) -> Pipeline:
    """Inverse document frequencies of hashed n-grams and multinomial logistic regression."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"),
            IDF(inputCol="tf", outputCol="x", minDocFreq=2),
            LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=0.01),
        ]
    )


def compare(docs: DataFrame, share: int = 5) -> DataFrame:
    """model, rows, accuracy on the documents whose hash falls into one of ``share`` parts (doc_id, text, label)."""
    rows = hashed(docs.where("label is not null and text is not null"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0
    train, test = rows.where(~part), rows.where(part)
    usual = train.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("usual"))
    majority = test.select("label").crossJoin(F.broadcast(usual)).agg(F.count("*").alias("rows"), F.round(F.avg((F.col("label") == F.col("usual")).cast("int")), 6).alias("accuracy"))
    model = ngram_model().fit(train)
    hits = model.transform(test).agg(F.count("*").alias("rows"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("int")), 6).alias("accuracy"))
    return majority.select(F.lit("majority").alias("model"), "rows", "accuracy").union(hits.select(F.lit("ngrams"), "rows", "accuracy"))


#: Sizes of the n-grams, most of them in the vocabulary, documents that a gram needs.
SIZES, FEATURES, LEAST_DOCS = (2, 3, 4), 60_000, 2
#: Rows of a slab, at most; pairs of characters up to which they are counted in a table.
SLAB_ROWS, TABLE = 1 << 18, 1 << 24
#: Multiplications of one product in a step, at most.
SMALL = 1 << 17
#: Rows that a task fits at once, times it goes through them, rows of a step, and the step's size.
CHUNK, TURNS, STEP_ROWS, RATE = 2048, 20, 16, 0.5


def plain_text(text: Column) -> Column:
    """Small letters, runs of white space as one space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _grams(text: Column) -> Column:
    """All n-grams of a text's plain_text()."""

    def of(chars: Column, n: int) -> Column:
        """Characters zipped with themselves; a substring would scan the text from its start."""
        tails = [F.slice(chars, k + 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))) for k in range(n)]
        out = tails[0]
        for tail in tails[1:]:
            out = F.zip_with(out, tail, lambda a, b: F.concat(a, b))
        return out

    # bound to a variable, or it would be made anew for each part
    return F.flatten(F.transform(F.array(F.split(plain_text(text), "")), lambda c: F.concat(*[of(c, n) for n in SIZES])))


def gram_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, gram, tf; every gram is a row. Of whole texts, gram_totals() and vectors() make the same without these rows."""
    return spread(docs.select(key, F.explode(_grams(F.col(text))).alias("gram"))).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, key: str, rows: int, features: int = FEATURES) -> DataFrame:
    """gram, feature (from 0, by gram), idf: the most frequent grams of all texts that are in several of them, ties by gram."""
    return chosen(counts.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")), rows, features)


def chosen(total: DataFrame, rows: int, features: int = FEATURES) -> DataFrame:
    """vocabulary() of gram, tf, df."""
    best = total.where(F.col("df") >= LEAST_DOCS).orderBy(F.desc("tf"), "gram").limit(features).withColumn("idf", F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0)
    # at most ``features`` rows are numbered
    listed = best.agg(F.array_sort(F.collect_list(F.struct("gram", "idf"))).alias("all"))
    return listed.select(F.posexplode("all").alias("feature", "x")).select("x.gram", "feature", "x.idf")


def weighted(counts: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """key, features, weights: (1 + log tf) idf of the known grams, of length 1; texts without any have no row."""
    met = counts.join(F.broadcast(words), "gram").select(key, "feature", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = met.groupBy(key).agg(F.collect_list(F.struct("feature", "w")).alias("e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select(key, F.col("e.feature").alias("features"), F.transform("e", lambda x: x["w"] / F.col("norm")).alias("weights"))


class Slab:
    """The n-grams of some texts as numbers, made of the places of their first and last pair of characters."""

    def __init__(self, texts: pa.Array):
        rows = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
        points = np.concatenate([np.zeros(0, np.uint32), *rows])
        self.rows, self.row = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        place = np.zeros(0x110000, np.int64)
        place[points] = 1
        letters = np.flatnonzero(place)
        place[letters] = np.arange(len(letters))
        letter = place[points]
        pair = letter[:-1] * len(letters) + letter[1:]
        if len(letters) ** 2 <= TABLE:
            known = np.zeros(len(letters) ** 2, np.int64)
            known[pair] = 1
            pairs = np.flatnonzero(known)
            known[pairs] = np.arange(len(pairs))
            self.pair = known[pair]
        else:
            pairs, self.pair = np.unique(pair, return_inverse=True)
        self.first, self.second = (letters[x].astype("<u4") for x in np.divmod(pairs, max(1, len(letters))))

    def counts(self, n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams (n: 2 to 4), and place among them, row and count of each that a row has, by place."""
        at = np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])
        number = self.pair[at]
        if n > 2:
            number = number * len(self.first) + self.pair[at + n - 2]
        met, tf = np.unique(number * self.rows + self.row[at], return_counts=True)
        number, row = np.divmod(met, max(1, self.rows))
        new = np.append(True, number[1:] != number[:-1])[: len(number)]
        head, tail = np.divmod(number[new], len(self.first)) if n > 2 else (number[new], number[new])
        chars = [self.first[head], self.second[head], self.first[tail], self.second[tail]]
        joined = np.stack(chars[:2] + chars[6 - n :], axis=1).tobytes().decode("utf-32-le")
        return [joined[i : i + n] for i in range(0, len(joined), n)], np.cumsum(new) - 1, row, tf


def gram_totals(texts: DataFrame) -> DataFrame:
    """gram, tf, df of texts (text: plain_text()), counted in slabs where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan.slabs(batch, SLAB_ROWS):
                slab = Slab(part.column(0))
                for n in SIZES:
                    grams, place, _, tf = slab.counts(n)
                    total = [np.bincount(place, x, len(grams)).astype(np.int64) for x in (tf, None)]
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *map(pa.array, total)], ["gram", "tf", "df"])

    each = texts.select("text").mapInArrow(run, "gram string, tf long, df long")
    return each.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vectors(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The columns before text (plain_text(), the last one) and features, weights, as weighted() makes them; empty lists for texts without known grams.

    words: gram, feature, idf, which go to every task.
    """
    held = words.orderBy("feature").toArrow()
    sent = texts.sparkSession.sparkContext.broadcast((held.column("gram").to_pylist(), held.column("idf").to_numpy()))
    kept = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, idf = sent.value
        number = {g: i for i, g in enumerate(grams)}
        for batch in batches:
            for part in scan.slabs(batch, SLAB_ROWS):
                slab, found = Slab(part.column(len(kept))), []
                for n in SIZES:
                    own, place, row, tf = slab.counts(n)
                    feature = np.fromiter((number.get(g, -1) for g in own), np.int64, len(own))[place]
                    some = feature >= 0
                    found.append((row[some], feature[some], (1.0 + np.log(tf[some])) * idf[feature[some]]))
                row, feature, weight = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")
                row, feature, weight = row[order], feature[order], weight[order]
                weight = weight / np.sqrt(np.bincount(row, weight**2, slab.rows))[row]
                ends = pa.array(np.searchsorted(row, np.arange(slab.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(feature, pa.int32()), pa.array(weight))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], [*kept, "features", "weights"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.mapInArrow(run, f"{kinds}, features array<int>, weights array<double>")


class Linear:
    """One linear model a label over sparse rows, all updated at once by logistic loss."""

    def __init__(self, features: int, labels: int):
        self.w, self.bias = np.zeros((features, labels), np.float32), np.full(labels, -1.0, np.float32)
        self.past, self.past_bias = np.full((features, labels), 1e-2, np.float32), np.full(labels, 1e-2, np.float32)

    def scores(self, begin: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.tile(self.bias, (len(begin) - 1, 1))
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            out[some] += np.add.reduceat(self.w[feature] * weight[:, None], begin[some], axis=0)
        return out

    def step(self, begin: np.ndarray, feature: np.ndarray, weight: np.ndarray, y: np.ndarray) -> None:
        """Adaptive gradient descent on a few rows, whose features are distinct; rare grams take larger steps."""
        met = np.zeros(len(self.w), bool)
        met[feature] = True
        own = np.flatnonzero(met)
        place = np.zeros(len(self.w), np.int32)
        place[own] = np.arange(len(own))
        cells = np.zeros(len(y) * len(own), np.float32)
        cells[np.repeat(np.arange(len(y)) * len(own), np.diff(begin)) + place[feature]] = weight
        x = cells.reshape(len(y), len(own))
        w, past = self.w.take(own, axis=0), self.past.take(own, axis=0)
        # in products so small that BLAS starts no threads for them; those of a step would only wait for each other
        cols = max(1, SMALL // y.size) if y.size else 1
        parts = [slice(a, a + cols) for a in range(0, len(own), cols)]
        score = sum((x[:, p] @ w[p] for p in parts), np.zeros(y.shape, np.float32))
        error = (1 / (1 + np.exp(-(score + self.bias))) - y).astype(np.float32)
        gradient = np.concatenate([x[:, p].T @ error for p in parts]) if parts else np.zeros_like(w)
        past += gradient**2
        gradient *= RATE
        gradient /= np.sqrt(past)
        w -= gradient
        self.w[own], self.past[own] = w, past
        b = error.sum(axis=0)
        self.past_bias += b**2
        self.bias -= RATE * b / np.sqrt(self.past_bias)


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, w = batch.column(0), batch.column(1)
    offsets = np.asarray(f.offsets)
    return offsets - offsets[0], np.asarray(f.flatten()), np.asarray(w.flatten()).astype(np.float32)


def fit(rows: DataFrame, features: int, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) from features, weights, ys (label numbers), in one pass over the rows.

    Every task fits its rows, a chunk after the other, and the tasks' models are
    averaged by their rows, label by label. A model is as large as labels times
    features, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, rng = Linear(features, labels), 0, np.random.default_rng(0)
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                begin, f, w = _sparse(batch)
                y = np.zeros((batch.num_rows, labels), np.float32)
                of = np.asarray(batch.column(2).offsets)
                y[np.repeat(np.arange(len(y)), np.diff(of)), np.asarray(batch.column(2).flatten())] = 1
                seen += len(y)
                for _ in range(TURNS):
                    order = rng.permutation(len(y))
                    for at in range(0, len(y), STEP_ROWS):
                        part = order[at : at + STEP_ROWS]
                        size = np.diff(begin)[part]
                        where = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        model.step(np.concatenate([[0], np.cumsum(size)]), f[where], w[where], y[part])
        if seen:
            full = np.concatenate([model.w, model.bias[None]]).T.astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array(range(labels), pa.int32()), pa.array([seen] * labels, pa.int64()), pa.array([x.tobytes() for x in full], pa.binary())], ["label", "n", "w"])

    def averaged(table: pa.Table) -> pa.Table:
        n = np.asarray(table.column("n"), np.float64)
        w = np.stack([np.frombuffer(x, "<f4") for x in table.column("w").to_pylist()])
        mean = (w * (n / n.sum())[:, None]).sum(axis=0).astype("<f4")
        return pa.table({"label": table.column("label")[:1], "w": pa.array([mean.tobytes()], pa.binary())})

    models = rows.select("features", "weights", "ys").mapInArrow(run, "label int, n long, w binary")
    full = np.zeros((labels, features + 1), np.float32)
    for r in models.groupBy("label").applyInArrow(averaged, "label int, w binary").collect():
        full[r["label"]] = np.frombuffer(r["w"], "<f4")
    return full[:, :-1].T.copy(), full[:, -1].copy()


def multilabel(train: DataFrame, validation: DataFrame, key: str, text: str, labels: str, features: int = FEATURES) -> DataFrame:
    """model, rows, micro_f1, features of the most frequent label and of linear models over n-grams (labels: lists).

    A row gets the labels with a probability of 0.5 or more, else its likeliest.
    Labels that no training row has count as missed.
    """
    spark = train.sparkSession
    listed = F.array_distinct(F.coalesce(F.array_compact(labels), F.array().cast("array<string>")))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # dealt by a hash, so that a task's rows are of all kinds
    train, validation = (stored(d.select(listed.alias("labels"), plain_text(F.col(text)).alias("text"), key).repartition(parts, key).drop(key), "texts") for d in (train, validation))
    support = {r["label"]: r["n"] for r in train.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(support)
    number = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map().cast("map<string,int>")
    rows = train.count()
    words = stored(chosen(gram_totals(train), rows, features), "vocabulary")
    size = words.count()
    fitted = vectors(train.coalesce(max(1, -(-rows // CHUNK))).select(F.transform("labels", lambda x: F.element_at(number, x)).alias("ys"), "text"), words)
    w, bias = fit(fitted.where(F.size("features") > 0), size, len(names))
    asked = vectors(validation, words)
    sent = spark.sparkContext.broadcast((w, bias))  # as large as labels times features

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Linear(0, 0)
        model.w, model.bias = sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                score = model.scores(*_sparse(batch))
                chosen = score >= 0
                empty = np.flatnonzero(~chosen.any(axis=1))
                if score.shape[1]:
                    chosen[empty, score[empty].argmax(axis=1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([[names[j] for j in np.flatnonzero(c)] for c in chosen], pa.list_(pa.string())), batch.column(2)], ["predicted", "labels"])

    told = asked.select("features", "weights", "labels").mapInArrow(predict, "predicted array<string>, labels array<string>")
    usual = min(names, key=lambda n: (-support[n], n)) if names else None
    guessed = validation.select(F.array(F.lit(usual).cast("string")).alias("predicted"), "labels")

    def scored(df: DataFrame, name: str, used: int) -> DataFrame:
        hit = F.sum(F.size(F.array_intersect("predicted", "labels")))
        return df.agg(F.count("*").alias("rows"), F.round(2 * hit / F.sum(F.size("predicted") + F.size("labels")), 6).alias("micro_f1")).select(F.lit(name).alias("model"), "rows", "micro_f1", F.lit(used).alias("features"))

    return scored(guessed, "majority", 0).union(scored(told, "ngrams", size))
