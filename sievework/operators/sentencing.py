"""Sentencing: evidence search over hashed n-grams, the hierarchical baseline and the service's rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import features, rules
from sievework.functions.money import bucket, bucket_range
from sievework.functions.redaction import tags
from sievework.functions.text import character_ngrams, md5_bits
from sievework.session import spread
from sievework.sources.files import stored

from . import scan, sparse

#: Buckets of hashed n-grams, sizes of the n-grams.
BUCKETS, SIZES = 1 << 18, (2, 3, 4)
#: Numbers that are looked up in a table, grams whose buckets a task keeps, at most.
TABLE, KEPT = 1 << 23, 1_000_000
#: Entries of queries' vectors that are sent to every task; queries of a bucket from which on it is in a matrix.
SENT, OFTEN = 2_000_000, 8
# Parts of the evidence score, its least value, texts that are too short, the confidence below which a person reviews.
WEIGHTS, MIN_SCORE, MIN_CHARS, REVIEW = (0.70, 0.20, 0.10), 0.20, 20, 0.60


def model_text(labels: Column, fact: Column) -> Column:
    """The labels in front of the fact, or that they aren't known."""
    known = F.concat(F.lit("已知罪名:"), F.array_join(labels, "、"), F.lit("。"))
    return F.concat(F.when(F.size(labels) > 0, known).otherwise("罪名未知。"), F.trim(fact))


def training_text(case_id: Column, labels: Column, fact: Column) -> Column:
    """Half of the cases (by a hash of their id) keep their labels, so that a model learns to do without them."""
    odd = F.conv(F.substring(F.sha1(case_id), 1, 2), 16, 10).cast("int") % 2 == 1
    return model_text(F.when(odd, labels), fact)


def ngrams(text: Column) -> Column:
    return F.concat(*[character_ngrams(text, n) for n in SIZES])


def vectors(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, bucket, weight: hashed n-gram counts scaled to length 1."""
    counts = spread(df).select(F.col(key).alias("key"), F.explode(ngrams(text)).alias("gram")).groupBy("key", (md5_bits(F.col("gram")) % BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("key").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, "key").select(F.col("key").alias(key), "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def packed(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, buckets, weights: the same vectors, one row each, made where the texts are read; every row is a text of its own, those without grams have none."""
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text.alias("text")).where("text is not null")).mapInArrow(_packed, f"{key} {kind}, buckets array<bigint>, weights array<double>")


def _bucket(gram: str) -> int:
    """The bucket of md5_bits()."""
    return (int.from_bytes(hashlib.md5(gram.encode()).digest()[:8], "big") >> 4) % BUCKETS


class _Counter:
    """Counts of the hashed grams of texts; buckets that were found are kept."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _buckets(self, grams: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known = {}
        made = list(map(self.known.get, grams))
        for i, b in enumerate(made):
            if b is None:
                made[i] = self.known[grams[i]] = _bucket(grams[i])
        return np.array(made, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and count of each pair that occurs, by row and bucket."""
        met = scan._chars(texts)
        # characters by their place among the slab's own
        place = np.zeros(scan.NONE + 1, np.int64)
        place[met[0]] = place[scan.NONE] = 1
        letters = np.flatnonzero(place)
        place[letters] = np.arange(len(letters))
        pairs = []
        for n in SIZES:
            chars, row, _ = scan.grams(texts, n, met)
            # a gram's number is that of its beginning and its last character, numbered anew after each
            number, size = place[chars[0]], len(letters)
            for c in chars[1:]:
                number, size = _renumbered(number * len(letters) + place[c], size * len(letters))
            first = np.zeros(size, np.int64)
            first[number] = np.arange(len(number))
            some = chars[:, first].T if size else np.zeros((0, n), np.uint32)
            if letters[0]:
                # text of numpy ends before its last zeros
                grams = np.ascontiguousarray(np.where(some == scan.NONE, 0, some).astype(np.uint32)).view(f"<U{n}").ravel().tolist()
            else:
                grams = ["".join(chr(c) for c in g if c != scan.NONE) for g in some.tolist()]
            pairs.append(row * np.int64(BUCKETS) + self._buckets(grams)[number])
        pairs, many = np.unique(np.concatenate(pairs), return_counts=True)
        return pairs // BUCKETS, pairs % BUCKETS, many


def _renumbered(number: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers below ``size`` as places among those that occur, and how many these are."""
    if size > TABLE:
        own, number = np.unique(number, return_inverse=True)
        return number, len(own)
    seen = np.zeros(size, bool)
    seen[number] = True
    own = np.flatnonzero(seen)
    place = np.zeros(size, np.int64)
    place[own] = np.arange(len(own))
    return place[number], len(own)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = _Counter()
    for batch in batches:
        for slab in scan.slabs(batch, scan.CELLS):
            row, bucket, many = count(slab.column(1))
            held, begin = np.unique(row, return_index=True)
            size = np.diff(np.append(begin, len(row)))
            norm = np.sqrt(np.bincount(row, many.astype(float) ** 2, slab.num_rows)[held])
            offsets = pa.array(np.append(begin, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (bucket, many / np.repeat(norm, size))]
            yield pa.RecordBatch.from_arrays([slab.column(0).take(pa.array(held)), *lists], [batch.schema.names[0], "buckets", "weights"])


class _Asked:
    """Some queries' vectors by bucket: a matrix of the buckets that many of them have, and lists of the others."""

    def __init__(self, start: int, query: np.ndarray, bucket: np.ndarray, weight: np.ndarray, size: int, least: int):
        self.start, self.size = start, size
        many = np.bincount(bucket, minlength=BUCKETS)
        often = np.flatnonzero(many >= least)
        often = often[np.argsort(-many[often], kind="stable")[: scan.CELLS // scan.BLOCK]]
        self.column = np.full(BUCKETS, -1, np.int32)
        self.column[often] = np.arange(len(often))
        inside = self.column[bucket] >= 0
        self.matrix = np.zeros((len(often), size))
        np.add.at(self.matrix, (self.column[bucket[inside]], query[inside]), weight[inside])
        order = np.argsort(bucket[~inside], kind="stable")
        self.query, self.weight = query[~inside][order], weight[~inside][order]
        self.first = np.searchsorted(bucket[~inside][order], np.arange(BUCKETS + 1))

    def scores(self, rows: int, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Rows by queries."""
        at = self.column[bucket]
        inside = at >= 0
        own = np.zeros((rows, len(self.matrix)))
        own[row[inside], at[inside]] = weight[inside]
        score = own @ self.matrix
        row, bucket, weight = row[~inside], bucket[~inside], weight[~inside]
        many = self.first[bucket + 1] - self.first[bucket]
        row, bucket, weight, many = (x[many > 0] for x in (row, bucket, weight, many))
        at = np.repeat(self.first[bucket] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return score + np.bincount(np.repeat(row * self.size, many) + self.query[at], np.repeat(weight, many) * self.weight[at], rows * self.size).reshape(rows, self.size)


def _near(asked, k: int, block: int, least: int):
    """The k best documents (doc, gates, text) of each query among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begin, bucket, weight, gates = asked.value
        query, starts = np.repeat(np.arange(len(ids)), np.diff(begin)), range(0, len(ids), block)
        blocks = []
        for start in starts:
            size = min(block, len(ids) - start)
            own = slice(begin[start], begin[start + size])
            blocks.append(_Asked(start, query[own] - start, bucket[own], weight[own], size, least))
        number = {g: i for i, g in enumerate(dict.fromkeys(g for gs in gates for g in gs))}
        wanted = np.zeros((len(number), len(ids)), np.float32)
        for q, gs in enumerate(gates):
            wanted[[number[g] for g in gs], q] = 1
        top, count = scan._Best(len(ids), k, once=True), _Counter()
        most = max(1, scan.CELLS // max(block, len(number), *(len(b.matrix) for b in blocks)))
        for batch in batches:
            for slab in scan.slabs(batch, scan.CELLS):
                doc = np.asarray(slab.column(0))
                row, bucket, many = count(slab.column(2))
                norm = np.sqrt(np.bincount(row, many.astype(float) ** 2, slab.num_rows))
                weight = many / norm[row]
                listed = slab.column(1).to_pylist()
                for a in range(0, slab.num_rows, most):
                    rows = min(most, slab.num_rows - a)
                    own = slice(*np.searchsorted(row, [a, a + rows]))
                    has = np.zeros((rows, len(number)), np.float32)
                    for i, gs in enumerate(listed[a : a + rows]):
                        has[i, [number[g] for g in gs if g in number]] = 1
                    for b in blocks:
                        raw = b.scores(rows, row[own] - a, bucket[own], weight[own])
                        score = np.round(raw, 9)
                        r, q = np.nonzero((raw > 0) & (score >= top.low[b.start : b.start + b.size]) & (has @ wanted[:, b.start : b.start + b.size] > 0))
                        top.add(q + b.start, score[r, q], doc[a + r])
        if len(top.query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[top.query]), pa.array(top.doc), pa.array(top.score)], ["query", "doc", "cosine"])

    return run


def similar_texts(docs: DataFrame, queries: DataFrame, k: int = 3, multiplier: int = 20) -> DataFrame:
    """similar_cases() of documents without vectors yet (doc, text, labels).

    Queries that fit a task are sent to where the texts are read, so that no vector
    of a document is written or shuffled; for more queries the vectors are made.
    """
    most = max(k * multiplier, k)
    queries = stored(queries.where(F.col("query").isNotNull() & (F.size("buckets") > 0)), "asked")
    docs = docs.where("doc is not null and text is not null")
    size, n = queries.agg(F.coalesce(F.sum(F.size("buckets")), F.lit(0)), F.count("*")).first()
    if size > SENT or n > SENT // 100:
        # rows of one id are texts of their own, each with its own labels
        made = stored(packed(docs.select(F.struct("doc", "labels").alias("key"), "text"), "key", F.col("text")), "vectors")
        return similar_cases(made.select("key.*", "buckets", "weights"), queries, k, multiplier)
    if not n:
        return docs.sparkSession.createDataFrame([], "query long, doc long, cosine double")
    held = queries.select(F.col("query").cast("long"), "buckets", "weights", sparse.asked_gates(F.col("labels")).alias("gates")).toArrow().combine_chunks()
    buckets, weights = (held.column(c).combine_chunks() for c in ("buckets", "weights"))
    begin = np.concatenate([[0], np.cumsum(np.asarray(buckets.value_lengths()))])
    asked = docs.sparkSession.sparkContext.broadcast((held.column("query").to_numpy(), begin, np.asarray(buckets.flatten()), np.asarray(weights.flatten()), held.column("gates").to_pylist()))
    rows = spread(docs.select(F.col("doc").cast("long").alias("doc"), sparse.gates(F.col("labels")).alias("gates"), "text"))
    found = rows.mapInArrow(_near(asked, most, scan.BLOCK, OFTEN), "query long, doc long, cosine double").distinct()
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "doc")
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def similar_cases(docs: DataFrame, queries: DataFrame, k: int = 3, multiplier: int = 20) -> DataFrame:
    """query, doc, cosine of each query's best candidates for evidence(); gates are lists of labels.

    docs: doc, buckets, weights, labels; queries: query, buckets, weights, labels.
    Only documents that share a label with the query take part; a query without labels meets all.
    """
    return sparse.nearest(docs, queries, "doc", "query", max(k * multiplier, k), F.col("labels"), F.col("labels"))


def cosines(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc, cosine of those that share a bucket (docs: doc, bucket, weight; queries: query, bucket, weight).

    Nearly all pairs: for small tables. similar_cases() makes no such pairs.
    """
    met = queries.withColumnRenamed("weight", "w").join(docs, "bucket")
    return met.groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("weight")), 9).alias("cosine"))


def evidence(scored: DataFrame, k: int = 3, candidates: int = 20) -> DataFrame:
    """The best k cases of each query: cosine, structure (0 to 1) and whether the label sets are equal, weighted.

    scored: query, doc, case_id, cosine, structure, same_labels. Only the best
    candidates by cosine are weighted.
    """
    near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "doc"))
    some = scored.withColumn("__n", near).where(F.col("__n") <= max(k * candidates, k))
    a, b, c = WEIGHTS
    total = F.round(a * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))) + b * F.col("structure") + c * F.col("same_labels").cast("double"), 9)
    good = some.withColumn("score", F.least(F.lit(1.0), total)).where(F.col("score") >= MIN_SCORE)
    first = F.row_number().over(Window.partitionBy("query", "case_id").orderBy(F.desc("score"), "doc"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return good.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("rank", rank).where(F.col("rank") <= min(k, 3))


def structure(fact_a: Column, fact_b: Column) -> Column:
    """Similarity of the factors and amounts that two facts state."""
    return features.evidence_similarity(tags(fact_a, rules.ZH_FACTORS), tags(fact_b, rules.ZH_FACTORS), features.amount(fact_a), features.amount(fact_b))


def classifier(target: str, weight: str | None = None, buckets: int = BUCKETS, iterations: int = 20) -> Pipeline:
    """A class of a row from its grams column."""
    more = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[StringIndexer(inputCol=target, outputCol="__y", handleInvalid="keep"), HashingTF(inputCol="grams", outputCol="__tf", numFeatures=buckets), Normalizer(inputCol="__tf", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=iterations, regParam=1e-4, **more)])


def regressor(target: str, buckets: int = BUCKETS, iterations: int = 20) -> Pipeline:
    """log(1 + amount) of a row from its grams column, with a loss that large errors don't rule."""
    return Pipeline(stages=[HashingTF(inputCol="grams", outputCol="__tf", numFeatures=buckets), Normalizer(inputCol="__tf", outputCol="__x"), LinearRegression(featuresCol="__x", labelCol=target, loss="huber", maxIter=iterations, regParam=1e-4)])


class _Head:
    """A class of a row from its features: the likeliest one, and the probability of each."""

    def __init__(self, rows: DataFrame, target: str, iterations: int):
        seen = {r[0]: r[1] for r in rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*")).collect()}  # a few classes
        self.classes = sorted(seen)
        self.model = None
        if len(self.classes) > 1:
            total = sum(seen.values())
            place = F.create_map(*[F.lit(x) for i, c in enumerate(self.classes) for x in (c, float(i))])
            weight = F.create_map(*[F.lit(x) for c in self.classes for x in (c, total / (len(seen) * seen[c]))])
            known = rows.where(F.col(target).isNotNull()).select("__x", F.element_at(place, F.col(target)).alias("__y"), F.element_at(weight, F.col(target)).alias("__w"))
            self.model = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=iterations, regParam=1e-4, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__k").fit(known)

    def add(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with ``name`` and ``name_p``, a map from classes to probabilities; without any class both are empty."""
        if not self.classes:
            return rows.withColumns({name: F.lit(None).cast("string"), f"{name}_p": F.create_map().cast("map<string,double>")})
        if self.model is None:
            return rows.withColumns({name: F.lit(self.classes[0]), f"{name}_p": F.create_map(F.lit(self.classes[0]), F.lit(1.0))})
        p = vector_to_array("__p")
        named = F.map_from_arrays(F.array(*[F.lit(c) for c in self.classes]), p)
        best = F.get(F.array(*[F.lit(c) for c in self.classes]), F.array_position(p, F.array_max(p)).cast("int") - 1)
        return self.model.transform(rows).withColumns({name: best, f"{name}_p": named}).drop("__p", "__r", "__k")


class SentencingModel:
    """Kind of sentence, then months of fixed terms; whether there is a fine, then its amount.

    Classes are of text; amounts are regressed as log(1 + amount) and kept within the
    bucket that a classifier chose. Rows to fit: grams, sentence_type, months, fine;
    ``unknown`` kinds and null numbers don't count. A head whose target has one
    class only always gives it.
    """

    def __init__(self, rows: DataFrame, buckets: int = BUCKETS, iterations: int = 30):
        self.features = Pipeline(stages=[HashingTF(inputCol="grams", outputCol="__tf", numFeatures=buckets), Normalizer(inputCol="__tf", outputCol="__x")]).fit(rows)
        months = F.when(F.col("sentence_type") == "fixed_term", F.col("months"))
        paid = F.when(F.col("fine") > 0, F.col("fine"))
        x = self.features.transform(rows).select("__x", F.when(F.col("sentence_type") != "unknown", F.col("sentence_type")).alias("kind"), bucket(months, rules.IMPRISONMENT_EDGES).cast("string").alias("mb"), F.log1p(months).alias("m"), (F.col("fine") > 0).cast("string").alias("imposed"), bucket(paid, rules.FINE_EDGES).cast("string").alias("fb"), F.log1p(paid).alias("f"))
        self.heads = {n: _Head(x, n, iterations) for n in ("kind", "mb", "imposed", "fb")}
        self.amounts = {}
        for n in ("m", "f"):
            known = x.where(F.col(n).isNotNull())
            if not known.isEmpty():
                self.amounts[n] = LinearRegression(featuresCol="__x", labelCol=n, predictionCol=f"__{n}", loss="huber", maxIter=iterations, regParam=1e-4).fit(known.select("__x", n))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (grams) with sentence_type, its probabilities, months, fine and their ranges; what doesn't apply is null."""
        out = self.features.transform(rows)
        for n, head in self.heads.items():
            out = head.add(out, f"__{n}_c")
        for n in ("m", "f"):
            out = self.amounts[n].transform(out) if n in self.amounts else out.withColumn(f"__{n}", F.lit(None).cast("double"))
        kind, fined = F.col("__kind_c"), F.coalesce(F.element_at("__imposed_c_p", F.lit("true")), F.lit(0.0))
        ranges = {n: bucket_range(F.col(f"__{n}b_c").cast("int"), edges) for n, edges in (("m", rules.IMPRISONMENT_EDGES), ("f", rules.FINE_EDGES))}
        held = {n: clamped(F.greatest(F.col(f"__{n}"), F.log1p(F.lit(1.0))), r["lower"], r["upper"]).cast("long") for n, r in ranges.items()}
        when = {"m": kind == "fixed_term", "f": fined >= 0.5}
        own = {
            "sentence_type": kind,
            "sentence_type_probabilities": F.col("__kind_c_p"),
            "imprisonment_months": F.when(when["m"], held["m"]),
            "imprisonment_range": F.when(when["m"], ranges["m"]),
            "fine_probability": F.round(fined, 6),
            "fine_imposed": when["f"],
            "fine_amount": F.when(when["f"], held["f"]),
            "fine_range": F.when(when["f"], ranges["f"]),
        }
        keep = [c for c in rows.columns if c != "grams" and c not in own]
        return out.select(*keep, *[c.alias(n) for n, c in own.items()])


def clamped(value: Column, lower: Column, upper: Column) -> Column:
    """A regression's amount, within the bucket that the classifier chose."""
    return F.greatest(lower, F.least(upper, F.round(F.expm1(value))))


def service_decision(fact: Column, confidences: Column) -> Column:
    """STRUCT<abstained, confidence, requires_review>: short facts get no answer, uncertain ones a review."""
    short = F.length(F.trim(fact)) < MIN_CHARS
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(confidences), F.lit(1))
    confidence = F.when(short, 0.0).otherwise(F.round(mean, 6))
    return F.struct(short.alias("abstained"), confidence.alias("confidence"), (short | (confidence < REVIEW)).alias("requires_review"))
