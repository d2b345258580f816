"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.llm.labelled import adam, held_out, seeded_sample, sigmoid
from tarnwatch.scratch import Scratch

#: Hashed features of a text: its distinct words, and their first 5, 6 and 7 bytes.
BUCKET_BITS = 20
PREFIXES = (5, 6, 7)
#: Training documents at most: confirmed toxic ones, and others whose label is not looked at.
POSITIVES, UNLABELLED = 4_000, 12_000
#: A feature is used if positives have it at so many times the rate of the negatives (the unlabelled
#: rate less the positives' share of it), and of the used ones so large a share at most is expected by chance.
LEAST_RATIO, FALSE_FINDS = 4.0, 0.001
_VALUES, _INSIDE = words.byte_values(words.NOT_ALNUM, fold_case=True)
_KINDS = words.mixed(np.arange(31, 31 + len(PREFIXES) + 1, dtype=np.uint64))


def _features(column: pa.Array):
    """(row, sorted distinct buckets)."""
    for first, n, data, offsets in words.parts(column):
        starts, ends, text = words.word_spans(data, offsets, _INSIDE)
        kinds = [words.word_hashes(data, starts, ends, _VALUES) + _KINDS[0]]
        kinds += [words.word_hashes(data, starts, np.minimum(starts + p, ends), _VALUES) + _KINDS[i + 1] for i, p in enumerate(PREFIXES)]
        buckets = (words.mixed(np.stack(kinds, axis=1)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            yield first + i, buckets[at[i] : at[i + 1]].ravel()


def _distinct(batches):
    """Of each text its distinct buckets, and four minimum hashes of them in one number, which copies share."""
    for batch in batches:
        out, keys = [np.zeros(0, np.int32)] * batch.num_rows, np.zeros(batch.num_rows, np.uint64)
        for i, b in _features(batch.column("text")):
            out[i] = np.unique(b)
            if len(b):
                least = [words.mixed(out[i].astype(np.uint64) * k).min() for k in _KINDS | np.uint64(1)]
                keys[i] = words.shingle_hashes(np.array(least, dtype=np.uint64), len(least))[0]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(keys.view(np.int64)), pa.array(out, pa.list_(pa.int32()))], names=["positive", "key", "buckets"])


def _counted(batches):
    """(bucket, documents among the positives, among the unlabelled) of a task's documents."""
    counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for batch in batches:
        flags, rows = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool), batch.column("buckets")
        owner = np.repeat(flags, rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        for i, own in enumerate((flat[owner], flat[~owner])):
            counts[i] += np.bincount(own, minlength=1 << BUCKET_BITS)
    found = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[0, found]), pa.array(counts[1, found])], names=["bucket", "p", "u"])


def _only(chosen: np.ndarray):
    """Of each document the places of its chosen buckets."""

    def run(batches):
        place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            rows = [place[np.asarray(b, dtype=np.int64)] for b in batch.column("buckets").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([r[r >= 0] for r in rows], pa.list_(pa.int32()))], names=["positive", "places"])

    return run


class Model:
    """Weights of the chosen buckets, and a bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.place = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
        self.place[buckets] = np.arange(1, len(buckets) + 1)
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        for i, b in _features(column):
            known = self.place[b]
            z[i] += self.weights[np.unique(known[known > 0]) - 1].sum()
        return sigmoid(z)


def _beyond_chance(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Features that positives have more often than unlabelled documents, by Benjamini-Hochberg.

    Given p + u finds, p is binomial if both have the same rate; Chernoff's bound stands for the tail.
    """
    share, total = n_p / (n_p + n_u), np.maximum(p + u, 1)
    part = lambda k, f: k * np.log(np.maximum(k, 1e-9) / (total * f))
    tail = np.where(p > share * total, np.exp(-(part(p, share) + part(u, 1 - share))), 1.0)
    ranked = np.sort(tail[p + u > 0])
    passed = np.flatnonzero(ranked <= FALSE_FINDS * np.arange(1, len(ranked) + 1) / max(1, len(ranked)))
    return tail <= (ranked[passed[-1]] if len(passed) else -1.0)


def choose(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Buckets to be used, from the numbers of positive and unlabelled documents that have each."""
    if not n_p or not n_u:
        return np.zeros(0, dtype=np.int64)
    ratio = LEAST_RATIO / (1 + (LEAST_RATIO - 1) * prior)  # of the unlabelled rate; below 1 / prior, the most that can be
    expected = (u + 0.5) * n_p / n_u
    return np.flatnonzero((p >= ratio * expected) & _beyond_chance(p, u, n_p, n_u))


def fit(chosen: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, decay: float = 1e-3) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    Documents are arrays of places in ``chosen``. Where the corrected risk of
    the negatives falls below zero, steps go against it, so that the unlabelled
    positives are not learned as negatives.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))

    def sparse(docs):
        return np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate(docs).astype(np.int64), len(docs)

    (pr, pc, pn), (ur, uc, un) = sparse(positive), sparse(unlabelled)
    k = len(chosen)
    logits = lambda w, r, c, n: np.bincount(r, w[c], minlength=n) + w[k]
    back = lambda g, r, c: np.append(np.bincount(c, g[r], minlength=k), g.sum())

    def gradient(w):
        zp, zu = logits(w, pr, pc, pn), logits(w, ur, uc, un)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = back(sigmoid(zu) / un, ur, uc) - prior * back(sigmoid(zp) / pn, pr, pc)
        of_positive = prior * back(-sigmoid(-zp) / pn, pr, pc)
        return (of_positive + of_negative if negative >= 0 else -of_negative) + decay * np.append(w[:k], 0) * 0.1

    w = adam(gradient, k + 1)
    return Model(chosen, w[:k], float(w[k]))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, seed: int = 5, positives: int = POSITIVES, others: int = UNLABELLED) -> DataFrame:
    """Scores every text: doc_id, held_out, score (0 to 1, higher is likelier toxic), predicted.

    Learns from up to ``positives`` documents labelled toxic and up to ``others``
    taken whatever their label, none of them held out. The class prior is the
    labelled share of toxic documents that are not held out. Tasks hash their
    texts' words and word beginnings into 2^20 buckets and count them; one
    document of those that copy each other counts. What reaches the driver are
    the counts of buckets (2^20 rows at most) and of the sample the chosen
    buckets only. The model is fitted there in numpy and applied to all whole
    texts.

    Null and empty texts get the bias alone, repeated rows equal scores, a very
    long text is hashed as a whole; rows with a null id are scored and not
    learned from; a document with several labels is toxic if one says so;
    without positives every score is the prior; empty tables give no rows.
    Extra columns of both tables are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    labels = labels.select("doc_id", "toxic")
    marked = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = scratch.cut(marked.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("toxic")), "marked")
    n, toxic = marked.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = min(0.9, max(1e-3, (toxic or 0) / max(n, 1)))
    positive = seeded_sample(marked.where("toxic").select("id"), positives, seed).withColumn("positive", F.lit(True))
    ids = texts.where("not held_out").select(F.col("doc_id").alias("id"))
    unlabelled = seeded_sample(ids, others, seed + 1).withColumn("positive", F.lit(False))
    sample = scratch.cut(positive.union(unlabelled), "sample")  # positives + others rows at most
    taken = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("positive", "text")
    taken = scratch.cut(taken.mapInArrow(_distinct, "positive boolean, key long, buckets array<int>"), "features")
    taken = scratch.cut(taken.groupBy("positive", "key").agg(F.min("buckets").alias("buckets")), "without-copies")
    size = {r["positive"]: r["n"] for r in taken.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    counts = taken.mapInArrow(_counted, "bucket int, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
    p, u = np.zeros((2, 1 << BUCKET_BITS))
    p[counts["bucket"]], u[counts["bucket"]] = counts["p"], counts["u"]
    chosen = choose(p, u, size.get(True, 0), size.get(False, 0), prior)
    rows = taken.mapInArrow(_only(chosen), "positive boolean, places array<int>").toPandas()
    model = fit(chosen, rows["places"][rows["positive"]].to_list(), rows["places"][~rows["positive"].astype(bool)].to_list(), prior)
    parts = (model.buckets, model.weights, model.bias)

    def run(batches):
        own = Model(*parts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(own.score(batch.column("text")))], names=["doc_id", "held_out", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
