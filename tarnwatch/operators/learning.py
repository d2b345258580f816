"""Jobs around Spark ML models: folds by place, calibration, ridge, scoring in batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.functions.scalars import platt, unit_xyz
from tarnwatch.operators.corridor import area_within_radius, nearest_polygon_distance
from tarnwatch.operators.sampling import quota_sample
from tarnwatch.operators.spatial import nearest_within, none_within
from tarnwatch.scratch import Scratch


def _on_sphere(places: DataFrame) -> DataFrame:
    at = places.select("*", unit_xyz(F.col("lat"), F.col("lon")).alias("_p")).select("*", *[F.col(f"_p.{a}").alias(f"_{a}") for a in "xyz"])
    return VectorAssembler(inputCols=["_x", "_y", "_z"], outputCol="_v").transform(at).drop("_p", "_x", "_y", "_z")


def fit_blocks(places: DataFrame, k: int = 5, seed: int = 7) -> KMeansModel:
    """ML-01: k-means of distinct places (lat, lon) on the unit sphere."""
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="block").fit(_on_sphere(places.select("lat", "lon").distinct()))


def in_blocks(model: KMeansModel, places: DataFrame) -> DataFrame:
    return model.transform(_on_sphere(places)).drop("_v")


def spatial_blocks(places: DataFrame, k: int = 5, seed: int = 7) -> DataFrame:
    """ML-01: (id, lat, lon) -> block by k-means on the unit sphere."""
    return in_blocks(fit_blocks(places, k, seed), places)


#: Kilometres to a matched inventory lake and to stay clear of events, metres of the glacier context.
MATCH_KM, CLEAR_KM, CONTEXT_M = 1.0, 1.0, 10000.0


def leakage_free_dataset(events: DataFrame, lakes: DataFrame, glaciers: DataFrame, *, negatives: int, k: int = 5, seed: int = 42, match_km: float = MATCH_KM, first_radius: float = CONTEXT_M) -> DataFrame:
    """ML-02: breached and stable lakes with measured features only, and the block of each.

    ``events`` and ``lakes``: id, lat, lon, x, y (metric), area_km2, elev_m;
    ``glaciers``: polygons as edges (poly, x1, y1, x2, y2) in metres. An event's
    area and elevation are those of the nearest lake, else its own; events
    without either go. Blocks are fitted on events. Stable lakes are at least a
    kilometre from every event and are drawn by block in the events' shares,
    topped up from all. Rows that lack a feature are left out.
    """
    scratch = Scratch(events.sparkSession, "dataset")
    measured = lakes.select(F.col("id").alias("other"), F.col("area_km2").alias("_a"), F.col("elev_m").alias("_e"))
    found = nearest_within(events, lakes, match_km).join(measured.hint("merge"), "other", "left").select("id", "_a", "_e")
    sites = events.join(found.hint("merge"), "id").withColumns({"area_km2": F.coalesce("_a", "area_km2"), "elev_m": F.coalesce("_e", "elev_m")}).where("area_km2 > 0 AND elev_m IS NOT NULL")
    columns = ("id", "lat", "lon", "x", "y", "area_km2", "elev_m")
    sites = scratch.cut(sites.select(*columns), "events")
    model = fit_blocks(sites, k, seed)
    free = scratch.cut(in_blocks(model, none_within(lakes, events, CLEAR_KM).where("area_km2 > 0 AND elev_m IS NOT NULL").select(*columns)), "lakes")
    blocks = in_blocks(model, sites)
    whole = sites.agg(F.count("*").alias("_n"))
    quotas = blocks.groupBy("block").agg(F.count("*").alias("n")).join(F.broadcast(whole), F.lit(True)).select("block", F.rint(F.col("n") / F.col("_n") * negatives).alias("quota"))
    drawn = quota_sample(free, "block", quotas, seed, negatives)
    both = blocks.withColumn("breached", F.lit(1)).unionByName(drawn.withColumn("breached", F.lit(0)))
    both = scratch.cut(both.withColumns({"source_id": F.col("id"), "id": F.concat_ws("-", "breached", "id")}), "rows")
    far, ice = nearest_polygon_distance(both, glaciers, first_radius), area_within_radius(both, glaciers, CONTEXT_M)
    out = both.join(far.hint("merge"), "id", "left").join(ice.withColumnRenamed("area", "ice_m2").hint("merge"), "id", "left")
    logs = {"log_area": F.log1p("area_km2"), "log_distance": F.log1p("distance"), "log_ice": F.log1p(F.col("ice_m2") / 1e6)}
    return out.withColumns(logs).na.drop(subset=["elev_m", *logs]).select("id", "source_id", "breached", "block", "lat", "lon", "elev_m", *logs)


def missing_flags(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Missing features become 0 with a flag beside them, as the trees here take no NaN."""
    out = rows.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features})
    out = out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    return out, [*features, *[f"{f}_missing" for f in features]]


def block_cv(rows: DataFrame, features: Sequence[str], *, block: str = "block", id_col: str = "id", test: str = "true", trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """ML-03, ML-04: scores of each held block by trees of the others; folds with a single class are left out.

    ``test`` further limits the held rows (from a date on, say). Classes are
    weighted equally. Folds are few; fits and scores are distributed.
    """
    scratch = Scratch(rows.sparkSession, "folds")
    ready, columns = missing_flags(rows, features)
    ready = VectorAssembler(inputCols=columns, outputCol="_v").transform(ready.withColumn("label", F.col("label").cast("double"))).select(id_col, block, "label", "_v", F.expr(test).alias("_test"))
    ready = scratch.cut(ready, "rows")
    out = None
    for (held,) in ready.select(block).distinct().orderBy(block).collect():
        train = ready.where(F.col(block) != held)
        n, positive = train.agg(F.count("*"), F.sum("label")).first()
        if not n or positive in (0, n):
            continue
        weighted = train.withColumn("_w", F.when(F.col("label") == 1, F.lit(n / (2 * positive))).otherwise(F.lit(n / (2 * (n - positive)))))
        model = GBTClassifier(featuresCol="_v", weightCol="_w", maxIter=trees, maxDepth=depth, seed=seed).fit(weighted)
        scored = model.transform(ready.where((F.col(block) == held) & F.col("_test"))).select(id_col, block, "label", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return scratch.cut(out, "scores") if out is not None else ready.select(id_col, block, "label", F.lit(None).cast("double").alias("score")).limit(0)


def _fit_trees(train: DataFrame, vector: str, trees: int, depth: int, seed: int):
    """Trees with classes weighted equally; None where there is one class only."""
    n, positive = train.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        return None
    weight = F.when(F.col("label") == 1, F.lit(n / (2 * positive))).otherwise(F.lit(n / (2 * (n - positive))))
    return GBTClassifier(featuresCol=vector, weightCol="_w", maxIter=trees, maxDepth=depth, seed=seed).fit(train.withColumn("_w", weight))


def stacked_prior(rows: DataFrame, static: Sequence[str], features: Sequence[str], *, block: str = "block", id_col: str = "id", test: str = "true", trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """ML-05: scores of each held block by trees on the features and a prior from static ones, and by trees without the prior.

    The prior of a training row comes from rows outside its own and the held
    block; that of a held row from all training rows. A model without two
    blocks serves both ways round, so there is one for each pair of blocks.
    Ids are unique; ``test`` further limits the held rows. Folds whose training
    or held rows have one class are left out; where a prior's training rows
    have, the prior is missing. Blocks are few; fits and scores are distributed.
    """
    scratch, c = Scratch(rows.sparkSession, "stacked"), F.col
    ready, names = missing_flags(rows.withColumn("label", c("label").cast("double")), [*dict.fromkeys([*static, *features])])
    own = lambda of: [n for n in names if n.removesuffix("_missing") in of]
    ready = VectorAssembler(inputCols=own(static), outputCol="_s").transform(ready)
    ready = scratch.cut(VectorAssembler(inputCols=own(features), outputCol="_f").transform(ready).select(c(id_col).alias("_id"), c(block).alias("_b"), "label", "_s", "_f", F.expr(test).alias("_test")), "rows")
    blocks = [b for (b,) in ready.select("_b").distinct().orderBy("_b").collect()]
    prior = ready.sparkSession.createDataFrame([], "_id " + ready.schema["_id"].dataType.simpleString() + ", _held " + ready.schema["_b"].dataType.simpleString() + ", prior double")
    for i, a in enumerate(blocks):
        for b in blocks[i:]:
            model = _fit_trees(ready.where(~c("_b").isin(a, b)), "_s", trees, depth, seed)
            if model is not None:
                scored = model.transform(ready.where(c("_b").isin(a, b))).select("_id", F.when(c("_b") == a, F.lit(b)).otherwise(F.lit(a)).alias("_held"), vector_to_array("probability")[1].alias("prior"))
                prior = prior.unionByName(scored)
    prior = scratch.cut(prior, "priors")
    out = None
    for held in blocks:
        fold, with_prior = missing_flags(ready.join(prior.where(c("_held") == held).drop("_held"), "_id", "left"), ["prior"])
        fold = scratch.cut(VectorAssembler(inputCols=["_f", *with_prior], outputCol="_p").transform(fold), "fold")
        train, probe = fold.where(c("_b") != held), fold.where((c("_b") == held) & c("_test"))
        if probe.agg(F.countDistinct("label")).first()[0] < 2:
            continue
        stacked, plain = (_fit_trees(train, v, trees, depth, seed) for v in ("_p", "_f"))
        if stacked is None:
            continue
        one = stacked.transform(probe).withColumn("stacked", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        one = plain.transform(one).select(c("_id").alias(id_col), c("_b").alias(block), "label", "stacked", vector_to_array("probability")[1].alias("plain"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return ready.select(c("_id").alias(id_col), c("_b").alias(block), "label", F.lit(0.0).alias("stacked"), F.lit(0.0).alias("plain")).limit(0)
    return scratch.cut(out, "scores")


def cross_calibrated(scores: DataFrame, block: str = "block", method: str = "platt") -> DataFrame:
    """ML-06: out-of-fold scores of each block through a curve (platt or isotonic) fitted on those of the other blocks; as they are where these have one class."""
    rows = Scratch(scores.sparkSession, "calibrated").cut(scores.withColumn("label", F.col("label").cast("double")), "scores")
    out = None
    for (held,) in rows.select(block).distinct().orderBy(block).collect():
        others, own = rows.where(F.col(block) != held), rows.where(F.col(block) == held)
        if others.agg(F.countDistinct("label")).first()[0] < 2:
            one = own.withColumn("calibrated", F.col("score"))
        elif method == "platt":
            slope, offset = platt_fit(others)
            one = own.withColumn("calibrated", platt(F.col("score"), slope, offset))
        else:
            one = IsotonicRegression(featuresCol="score", predictionCol="calibrated").fit(others).transform(own)
        out = one if out is None else out.unionByName(one)
    return rows.withColumn("calibrated", F.col("score")) if out is None else out


def platt_fit(scores: DataFrame) -> tuple[float, float]:
    """ML-06: slope and offset of a logistic curve through out-of-fold scores."""
    ready = VectorAssembler(inputCols=["score"], outputCol="_v").transform(scores.select("score", F.col("label").cast("double").alias("label")))
    m = LogisticRegression(featuresCol="_v").fit(ready)
    return float(m.coefficients[0]), float(m.intercept)


def isotonic_fit(scores: DataFrame) -> list[tuple[float, float]]:
    """ML-06: knots of a rising step curve; use with ``functions.scalars.interpolate``."""
    m = IsotonicRegression(featuresCol="score").fit(scores.select("score", F.col("label").cast("double").alias("label")))
    return list(zip(map(float, m.boundaries), map(float, m.predictions), strict=True))


def residual_features(rows: DataFrame, kind: str, least: int = 5) -> DataFrame:
    """ML-09: log area and a kind whose rare values are one."""
    by = rows.groupBy(kind).agg(F.count("*").alias("_n"))
    return rows.join(by, kind).withColumns({"log_area": F.log("area"), kind: F.when(F.col("_n") >= least, F.col(kind)).otherwise("other")}).drop("_n")


def residual_ridge(rows: DataFrame, features: Sequence[str], law: str, truth: str, penalty: float = 1.0) -> DataFrame:
    """ML-10: ridge on the log of truth over law; predicts law x exp(fit)."""
    ready = VectorAssembler(inputCols=list(features), outputCol="_v").transform(rows.where((F.col(law) > 0) & (F.col(truth) > 0)).withColumn("_y", F.log(F.col(truth) / F.col(law))))
    model = LinearRegression(featuresCol="_v", labelCol="_y", predictionCol="_f", regParam=penalty, elasticNetParam=0.0).fit(ready)
    return model.transform(ready).withColumn("estimate", F.col(law) * F.exp("_f")).drop("_v", "_y", "_f")


#: A ridge on more features than this is no small system, and its moments no small table.
MOST_FEATURES = 1000


def sparse_features(rows: DataFrame, numeric: Sequence[str], kinds: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """ML-09: adds ``features``, pairs (i, v) of the numbers and of one 1 for each kind; values of a kind in fewer rows than its least have none.

    Also returns the features' names. Kinds are a dimension of a model, so
    their values are few: more than 1,000 in all are an error.
    """
    out, names = rows, list(numeric)
    parts = [F.struct(F.lit(i).alias("i"), F.col(n).cast("double").alias("v")) for i, n in enumerate(numeric)]
    for kind, least in kinds.items():
        common = rows.where(F.col(kind).isNotNull()).groupBy(kind).count().where(F.col("count") >= least).orderBy(kind).limit(MOST_FEATURES + 1)
        values = [v for (v,) in common.select(kind).collect()]
        if len(names) + len(values) > MOST_FEATURES:
            raise ValueError(f"more than {MOST_FEATURES} features")
        if values:
            places = rows.sparkSession.createDataFrame([(v, len(names) + i) for i, v in enumerate(values)], T.StructType([rows.schema[kind], T.StructField(f"_{kind}", T.IntegerType())]))
            out = out.join(F.broadcast(places), kind, "left")
            parts.append(F.when(F.col(f"_{kind}").isNotNull(), F.struct(F.col(f"_{kind}").alias("i"), F.lit(1.0).alias("v"))))
            names += [f"{kind}_{v}" for v in values]
    return out.withColumn("features", F.array_compact(F.array(*parts))).drop(*[f"_{k}" for k in kinds]), names


def _ridge_solver(total: np.ndarray, penalty: float):
    """Weights (offset first) of a ridge on standardised features, from moments of all rows less those of a group."""

    def solve(batches):
        for pdf in batches:
            weights = []
            for i, j, s in zip(pdf["i"], pdf["j"], pdf["s"], strict=True):
                m, i, j = total.copy(), np.asarray(i), np.asarray(j)
                m[i, j] -= s
                off = i != j
                m[j[off], i[off]] -= np.asarray(s)[off]
                n = m[0, 0]
                if n < 0.5:
                    weights.append(None)
                    continue
                mean, middle = m[0, 2:] / n, m[0, 1] / n
                spread = m[2:, 2:] - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(spread) / n, 0))
                sd[sd <= 1e-9 * np.maximum(1, np.abs(mean))] = 1.0
                w = np.linalg.solve(spread / np.outer(sd, sd) + penalty * np.eye(len(sd)), (m[2:, 1] - n * mean * middle) / sd) / sd
                weights.append([middle - w @ mean, *w])
            yield pdf[["_g"]].assign(_w=weights)

    return solve


def ridge_leave_groups_out(rows: DataFrame, group: str, width: int, law: str, truth: str, penalty: float = 1.0) -> DataFrame:
    """ML-10: each group's estimate, law x exp(ridge), by a ridge on log(truth / law) over all other groups.

    Needs ``features`` as ``sparse_features`` makes them, ``width`` of them.
    The moments of a fold are the totals less the group's own, which are sums
    of products of the features that are not 0: no loop over folds, and a group
    of any size is summed in parts. A group of no rows to fit on has no estimate.
    """
    ready = rows.where((F.col(law) > 0) & (F.col(truth) > 0) & F.col(group).isNotNull()).withColumn("_g", F.col(group))
    pair = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    terms = F.concat(F.array(pair(0, F.lit(1.0)), pair(1, F.log(F.col(truth) / F.col(law)))), F.transform("features", lambda f: F.struct((f["i"] + 2).alias("i"), f["v"].alias("v"))))
    product = lambda x: F.transform(F.filter("_t", lambda y: y["i"] >= x["i"]), lambda y: F.struct(x["i"].alias("i"), y["i"].alias("j"), (x["v"] * y["v"]).alias("s")))
    sums = ready.select("_g", terms.alias("_t")).select("_g", F.inline(F.flatten(F.transform("_t", product)))).groupBy("_g", "i", "j").agg(F.sum("s").alias("s"))
    sums = Scratch(rows.sparkSession, "ridge").cut(sums, "moments")
    total = np.zeros((width + 2, width + 2))
    for i, j, v in sums.groupBy("i", "j").agg(F.sum("s")).collect():  # half of (features + 2) squared at most
        total[i, j] = total[j, i] = v
    own = sums.groupBy("_g").agg(F.collect_list(F.struct("i", "j", "s")).alias("m")).select("_g", "m.i", "m.j", "m.s")
    solved = own.mapInPandas(_ridge_solver(total, penalty), T.StructType([T.StructField("_g", rows.schema[group].dataType), T.StructField("_w", T.ArrayType(T.DoubleType()))]))
    fitted = F.aggregate("features", F.col("_w")[0], lambda acc, f: acc + f["v"] * F.element_at("_w", f["i"] + 2))
    return ready.join(solved, "_g").withColumn("estimate", F.col(law) * F.exp(fitted)).drop("_g", "_w")


def percentile_against(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """ML-12: share of baseline scores strictly below each score; (id, score) and (score).

    Both are counted by thousandths first, and only scores of the same
    thousandth are compared one by one as distinct values.
    """
    bin_of = F.floor(F.col("score") * 1000)
    fine = baseline.groupBy(bin_of.alias("_b"), F.col("score").alias("s")).agg(F.count("*").alias("c"))
    coarse = fine.groupBy("_b").agg(F.sum("c").alias("n"))
    total = coarse.agg(F.sum("n").alias("all"))
    edges = scores.select(bin_of.alias("_b")).distinct().select("_b", F.lit(0).cast("long").alias("n")).unionByName(coarse).groupBy("_b").agg(F.sum("n").alias("n"))
    before = edges.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # about a thousand rows
    own = scores.withColumn("_b", bin_of).join(before.select("_b", "before"), "_b")
    distinct = own.select("_b", "score").distinct().join(fine, "_b", "left").groupBy("_b", "score").agg(F.coalesce(F.sum(F.when(F.col("s") < F.col("score"), F.col("c"))), F.lit(0)).alias("within"))
    return own.join(distinct, ["_b", "score"]).join(F.broadcast(total), F.lit(True)).select("id", "score", ((F.col("before") + F.col("within")) / F.col("all")).alias("percentile"))


def batch_scorer(model: Callable[[np.ndarray], np.ndarray], width: int, batch: int = 1024):
    """ML-13, UD-02: a column function that applies a vectorised model to float arrays of one width in batches."""
    return predict_batch_udf(lambda: model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[width]])
