"""Language identification by fusing text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm import words
from tarnwatch.llm.joins import with_groups
from tarnwatch.scratch import Scratch

LANGUAGES = ("en", "de", "fr", "es")
#: Classes: the languages, and text that is none of them (byte trigrams at random).
OTHER = "und"
#: Hashed byte trigrams of a language's model.
BUCKET_BITS = 15
#: Trigrams overlap and repeat: a text counts as so many independent ones at most.
MOST_EVIDENCE = 40.0
#: Rows that a host's own counts have to outweigh.
PRIOR_ROWS = 20.0
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint32)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams (A-Z as a-z) and whether each lies within its text; one for each byte but the last two."""
    b = _FOLD[data]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    inner = np.ones(len(code), dtype=bool)
    for back in (1, 2):
        cut = offsets[1:-1] - back
        inner[cut[(cut >= 0) & (cut < len(code))]] = False
    letters = (b[:-2] > 64) | (b[1:-1] > 64) | (b[2:] > 64)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), inner & letters


def _count(languages: Sequence[str]):
    def run(batches):
        counts = np.zeros((len(languages), 1 << BUCKET_BITS), dtype=np.int64)
        which = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            declared = np.array([which.get(x, -1) for x in batch.column("declared").to_pylist()])
            for first, n, data, offsets in words.parts(batch.column("text")):
                if len(data) < 3:
                    continue
                buckets, inner = _trigrams(data, offsets)
                owner = np.repeat(declared[first : first + n], np.diff(offsets))[: len(buckets)]
                for i in range(len(languages)):
                    counts[i] += np.bincount(buckets[inner & (owner == i)], minlength=1 << BUCKET_BITS)
        i, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[i, b])], names=["class", "bucket", "n"])

    return run


def fit_models(texts: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """log P(trigram | class) from all texts with a declared language; languages times 32,768 counts reach the driver."""
    counts = texts.mapInArrow(_count(languages), "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(languages) + 1, 1 << BUCKET_BITS), 0.5)
    n[counts["class"], counts["bucket"]] += counts["n"]
    n[-1] = 1.0
    return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(models: np.ndarray):
    def run(batches):
        for batch in batches:
            scores, grams = np.zeros((batch.num_rows, len(models))), np.zeros(batch.num_rows, dtype=np.int64)
            for first, n, data, offsets in words.parts(batch.column("text")):
                if len(data) < 3:
                    continue
                buckets, inner = _trigrams(data, offsets)
                at = np.minimum(offsets, len(buckets))
                sums = lambda x, at=at: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[at])
                grams[first : first + n] = sums(inner)
                for i, m in enumerate(models):
                    scores[first : first + n, i] = sums(m[buckets] * inner)
            scores *= (np.minimum(grams, MOST_EVIDENCE) / np.maximum(grams, 1))[:, None]
            kept = [batch.column(c) for c in ("id", "row", "declared", "host", "suffix")]
            values = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, len(models), dtype=np.int32), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(grams), values], names=["id", "row", "declared", "host", "suffix", "grams", "loglik"])

    return run


def _argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _shares(counts: DataFrame, key: list[str], classes: int) -> DataFrame:
    """(key, class) counts -> (key, n array<double> by class)."""
    return counts.groupBy(*key).agg(*[F.sum(F.when(F.col("best") == i, F.col("c")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(classes)]).select(
        *key, F.array(*[f"n{i}" for i in range(classes)]).alias("n")
    )


def _smoothed(n: Column, prior: Column) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(n, prior, lambda x, p: (x + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def identify(
    df: DataFrame,
    *,
    languages: Sequence[str] = LANGUAGES,
    least: float = 0.5,
    id_col: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
) -> DataFrame:
    """The language of each text from all the evidence there is.

    Text likelihoods come from byte-trigram models of the texts that declare a
    language. How often a declaration occurs with each language, and how a
    host's texts divide, are counted over all texts by their likeliest language
    (grouped aggregation); a host's share is smoothed toward that of its
    address suffix and this toward the whole. Posterior = likelihood of the
    text x P(declaration | language) x P(language | host).

    Returns _id, _row (hash of the text), language, posterior, accepted:
    rejected are texts without any trigram (null, empty, no letters), texts
    likelier to be random bytes than a language, and posteriors below
    ``least``. Missing evidence is neutral; repeated rows get equal results.
    Trigrams of a text depend on each other, so a text of more than
    ``MOST_EVIDENCE`` of them counts as so many: its likelihood is the mean one
    of a trigram to that power, over the whole text. Ties go to the first of
    ``languages``. Long texts are read whole, in parts; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "language")
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("text"),
        F.coalesce(F.lower(F.regexp_extract(none if declared is None else declared, "^[A-Za-z]{2,3}", 0)), F.lit("")).alias("declared"),
        F.coalesce(none if host is None else host, F.lit("")).alias("host"),
        F.coalesce(none if suffix is None else suffix, F.lit("")).alias("suffix"),
    ).withColumn("row", F.xxhash64("text"))
    classes = [*languages, OTHER]
    models = fit_models(rows.select("text", "declared"), languages)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, declared string, host string, suffix string, grams long, loglik array<double>"
    scored = scratch.cut(rows.mapInArrow(_score(models), schema), "scored")

    counts = scored.where("grams > 0").withColumn("best", _argmax(F.col("loglik"))).groupBy("declared", "host", "suffix", "best").agg(F.count("*").alias("c"))
    counts = scratch.cut(counts, "counts")
    k = len(classes)
    whole = counts.groupBy("best").agg(F.sum("c").alias("c")).collect()  # one row for each class
    total = sum(r["c"] for r in whole) + k
    share = F.array(*[F.lit((sum(r["c"] for r in whole if r["best"] == i) + 1) / total) for i in range(k)])
    suffixes = _shares(counts, ["suffix"], k).select("suffix", _smoothed(F.col("n"), share).alias("suffix_share"))
    hosts = _shares(counts, ["host", "suffix"], k).join(suffixes, "suffix").select(F.concat_ws("\n", "host", "suffix").alias("site"), _smoothed(F.col("n"), F.col("suffix_share")).alias("site_share"))
    known = counts.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.lit("")))
    known = {r["declared"]: r["n"] for r in _shares(known, ["declared"], k).collect()}  # languages + 1 rows
    of_class = [sum(n[i] for n in known.values()) for i in range(k)]
    claim = F.create_map(*[x for d in ("", *languages) for x in (F.lit(d), F.array(*[F.lit((known.get(d, [0.0] * k)[i] + 0.5) / (of_class[i] + 0.5 * (k))) for i in range(k)]))])

    judged = with_groups(scored.withColumn("site", F.concat_ws("\n", "host", "suffix")), hosts, "site", "id", scratch)
    told = F.when(F.col("declared").isin(*languages), claim[F.col("declared")]).otherwise(F.array(*[F.lit(1.0)] * k))
    prior = F.zip_with(F.coalesce("site_share", share), told, lambda p, c: F.log(p * c))
    joint = F.zip_with("loglik", prior, lambda t, p: t + p)
    judged = judged.withColumn("joint", joint)
    weight = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.array_max("joint"))), F.lit(0.0), lambda a, x: a + x)
    language = F.element_at(F.array(*[F.lit(c) for c in classes]), _argmax(F.col("joint")) + 1)
    return judged.select(
        F.col("id").alias("_id"),
        F.col("row").alias("_row"),
        F.when(F.col("grams") > 0, language).otherwise(F.lit(OTHER)).alias("language"),
        F.when(F.col("grams") > 0, 1 / weight).otherwise(F.lit(0.0)).alias("posterior"),
    ).withColumn("accepted", (F.col("language") != OTHER) & (F.col("posterior") >= least))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """Documents declare ``lang``; their source is the host, and they have no address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, declared=F.col("lang"), host=F.col("source"))
    return found.select(F.col("_id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "accepted", F.col("accepted").alias("kept"))


def pages_language(spark, sf_dir: str) -> DataFrame:
    """Pages declare a language in their markup, and have a host and an address suffix."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    host = F.parse_url("url", F.lit("HOST"))
    found = identify(
        pages, id_col="page_id", text=visible, declared=F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), host=host, suffix=F.element_at(F.split(host, r"\."), -1)
    )
    return found.select(F.col("_id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "accepted")
