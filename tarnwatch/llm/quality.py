"""Quality by hierarchical empirical Bayes: the document's own evidence, its path's and its host's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.llm.joins import with_groups
from tarnwatch.llm.labelled import adam, held_out, seeded_sample, sigmoid
from tarnwatch.scratch import Scratch

#: Labelled documents at most from which the classifier is fitted.
SAMPLE = 20_000
#: Steps into which each measure is cut for the additive model.
STEPS = 12
MEASURES = ("words", "mean_word", "upper", "digit", "space", "newline", "sentence", "bar", "bang", "symbol", "distinct_words", "distinct_lines")
_CLASS = np.full(256, 0, dtype=np.uint8)
for _i, _bytes in enumerate((bytes(range(65, 91)), bytes(range(48, 58)), b" \t", b"\n", b".,;:'\"()-?", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~"), start=1):
    _CLASS[list(_bytes)] = _i
_VALUES, _INSIDE = words.byte_values(words.SPACES, fold_case=True)
_LINE_VALUES, _LINE_INSIDE = words.byte_values(b"\n", fold_case=True)


def measures(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text; zeros for an empty one."""
    out = np.zeros((len(column), len(MEASURES)))
    for first, n, data, offsets in words.parts(column):
        size = np.maximum(np.diff(offsets), 1)
        kinds = _CLASS[data]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: E731, B023
        for k in range(1, 9):
            out[first : first + n, 1 + k] = sums(kinds == k) / size
        for column_at, inside, values in ((10, _INSIDE, _VALUES), (11, _LINE_INSIDE, _LINE_VALUES)):
            starts, ends, text = words.word_spans(data, offsets, inside)
            hashes = words.word_hashes(data, starts, ends, values)
            at = np.searchsorted(text, np.arange(n + 1))
            for i in range(n):
                own = hashes[at[i] : at[i + 1]]
                out[first + i, column_at] = len(np.unique(own)) / max(1, len(own)) ** (0.85 if column_at == 10 else 1)
            if column_at == 10:
                out[first : first + n, 0] = np.log1p(np.diff(at))
                out[first : first + n, 1] = np.diff(offsets) / np.maximum(1, np.diff(at))
    return out


def _steps(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which step of its measure each value is in, as columns of one long table."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * (STEPS + 1) for j in range(x.shape[1])], axis=1)


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Additive logistic model over quantile steps of each measure: (edges, weights with the bias last)."""
    edges = np.quantile(x, np.linspace(0, 1, STEPS + 1)[1:], axis=0).T if len(x) else np.zeros((len(MEASURES), STEPS))
    if not len(x) or y.min() == y.max():
        return edges, np.append(np.zeros(len(MEASURES) * (STEPS + 1)), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0)
    at, width = _steps(x, edges), len(MEASURES) * (STEPS + 1)

    def gradient(w):
        g = (sigmoid(w[at].sum(axis=1) + w[width]) - y) / len(y)
        return np.append(np.bincount(at.ravel(), np.repeat(g, at.shape[1]), minlength=width) + decay * w[:width], g.sum())

    return edges, adam(gradient, width + 1, steps=400)


#: Rows that a prior may weigh, at least and at most.
STRENGTHS = (1.0, 10_000.0)


def _rates(counts: DataFrame, key: list[str], strength: float) -> DataFrame:
    """Posterior mean of the good share for each group, shrunk toward ``prior`` by ``strength`` rows."""
    return counts.groupBy(*key).agg(((F.sum("good") + strength * F.first("prior")) / (F.sum("n") + strength)).alias("rate"))


def prior_strength(groups: DataFrame, parent: str) -> float:
    """Rows that a beta prior around the parent's share weighs, from how far the shares of its groups scatter.

    ``groups`` has a parent, n and good. The moments of the beta-binomial give
    the correlation within groups: variance between groups beyond what draws of
    their sizes would show. Strength = (1 - correlation) / correlation.
    """
    total = groups.groupBy(parent).agg(F.sum("n").alias("t"), F.sum("good").alias("g")).select(F.col(parent).alias("p"), "t", "g")
    share, own = F.col("g") / F.col("t"), F.col("good") / F.col("n")
    rows = groups.join(total, groups[parent] == F.col("p")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_distinct("p").alias("parents"), F.sum(F.col("n") * F.col("n") / F.col("t")).alias("squares"),
        F.sum(F.col("n") * (own - share) * (own - share)).alias("between"), F.sum(F.col("n") * own * (1 - own)).alias("within"),
    )
    r = rows.first()  # one row
    free = (r["groups"] or 0) - r["parents"]
    if free <= 0 or r["rows"] <= r["groups"]:
        return STRENGTHS[1]
    between, within = r["between"] / free, r["within"] / (r["rows"] - r["groups"])
    size = (r["rows"] - r["squares"]) / free
    spread = between + (size - 1) * within
    correlation = (between - within) / spread if spread > 0 else 0.0
    return float(min(STRENGTHS[1], max(STRENGTHS[0], (1 - correlation) / correlation))) if correlation > 0 else STRENGTHS[1]


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: Column | None = None,
    path: Column | None = None,
    least: float = 0.5,
    seed: int = 11,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (1: keep), and what the sites add.

    The document classifier is an additive logistic model of measures of the
    whole text, fitted in numpy on at most 20,000 labelled rows, none of them
    held out. Over all such labels, hosts get the posterior mean of their good
    share under a prior at the global share, and paths one under a prior at
    their host's, so that sparse sites stay near what is above them. How many
    rows each prior weighs is estimated at its level (``prior_strength``). The
    score adds the log odds of a path (or else its host, or nothing) against
    the global ones to the classifier's.

    Null and empty texts are scored by their measures of zero, very long ones
    as a whole; a null host or path is one of its own; documents without a
    label are scored like others; of several labels of an id the highest
    counts; repeated rows get equal scores; without labels all scores are 1/2;
    empty tables give no rows. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    host = F.coalesce(F.col("source") if host is None else host, F.lit(""))
    path = F.coalesce(F.col("lang") if path is None else path, F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            x = measures(batch.column("text"))
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("site"), values], names=["doc_id", "host", "site", "x"])

    rows = docs.select("doc_id", host.alias("host"), F.concat_ws("\n", host, path).alias("site"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.cut(rows.mapInArrow(measure, f"doc_id {kind}, host string, site string, x array<double>"), "measures")
    marked = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    known = scratch.cut(rows.join(marked, "doc_id").select(F.col("doc_id").alias("id"), "host", "site", F.col("good").cast("double").alias("good"), "x"), "known")
    sample = seeded_sample(known.select("id", "x", "good"), SAMPLE, seed).toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=float).reshape(-1, len(MEASURES))
    edges, weights = fit(x, sample.column("good").to_numpy())

    total = known.agg(F.sum("good"), F.count("*")).first()
    base = ((total[0] or 0) + 1) / (total[1] + 2)
    counts = known.groupBy("host", "site").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    counts = scratch.cut(counts, "counts")
    by_host = counts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("root", F.lit(""))
    hosts = _rates(counts.withColumn("prior", F.lit(base)), ["host"], prior_strength(by_host, "root"))
    paths = _rates(counts.join(hosts.withColumnRenamed("rate", "prior"), "host"), ["site"], prior_strength(counts, "host"))

    def classify(batches):
        for batch in batches:
            values = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            z = weights[_steps(values, edges)].sum(axis=1) + weights[-1] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("site"), pa.array(z)], names=["doc_id", "host", "site", "z"])

    judged = rows.mapInArrow(classify, f"doc_id {kind}, host string, site string, z double")
    judged = with_groups(judged, paths.withColumnRenamed("rate", "path_rate"), "site", "doc_id", scratch)
    judged = with_groups(judged, hosts.withColumnRenamed("rate", "host_rate"), "host", "doc_id", scratch)
    rate = F.coalesce("path_rate", "host_rate", F.lit(base))
    odds = F.log(rate / (1 - rate)) - F.lit(float(np.log(base / (1 - base))))
    scored = judged.withColumn("site_log_odds", odds).withColumn("score", 1 / (1 + F.exp(-(F.col("z") + F.col("site_log_odds")))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "site_log_odds", (F.col("score") >= least).alias("kept"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Documents: the source is the host, the language a path below it."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
