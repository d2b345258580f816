"""Registered queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import evaluation as E
from tarnwatch.plans import standins as T

QUERIES, ORACLE_SQL = {}, {}
TAUS = (0.1, 0.3, 0.5, 0.7, 0.9)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_M = "coalesce(round(tp / nullif(tp + fp + fn, 0), 9), 0) AS iou, coalesce(round(tp / nullif(tp + fp, 0), 9), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 9), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1"


@query("confusion_metrics", T.with_("scores") + f"""
, c AS (SELECT block, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label <> 1 AND score < 0.5) AS tn FROM scores GROUP BY block)
SELECT *, {_M} FROM c""")
def _(spark, d):
    return rounded(E.confusion_metrics(E.confusion(["block"], T.scores(spark, d), F.col("label") == 1, F.col("score") >= 0.5)), "iou", "precision", "recall", "f1")


@query("threshold_sweep", T.with_("scores") + f"""
, c AS (SELECT block, tau, count(*) FILTER (WHERE label = 1 AND score >= tau) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= tau) AS fp, count(*) FILTER (WHERE label = 1 AND score < tau) AS fn FROM scores, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau) GROUP BY block, tau),
i AS (SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS ciou FROM c),
p AS (SELECT tau, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(ciou), 9) AS mean_iou, round(median(ciou), 9) AS median_iou FROM i GROUP BY tau)
SELECT *, {_M}, tp / (tp + fp + fn) > 0.65 AS passed FROM p""")
def _(spark, d):
    return rounded(E.threshold_sweep(T.scores(spark, d), TAUS, "block"), "iou", "precision", "recall", "f1", "mean_iou", "median_iou")


@query("rank_auc", T.with_("scores") + """
, r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY score) + (count(*) OVER (PARTITION BY block, score) - 1) / 2.0 AS mid FROM scores),
a AS (SELECT block, (sum(mid) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)) AS auc, avg((score - label) * (score - label)) AS brier FROM r GROUP BY block),
t AS (SELECT block, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM scores GROUP BY block, score),
k AS (SELECT block, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM t WINDOW w AS (PARTITION BY block ORDER BY score DESC)),
ap AS (SELECT block, sum(pos * tp / n) / sum(pos) AS average_precision FROM k GROUP BY block)
SELECT block, round(auc, 9) AS auc, round(average_precision, 9) AS average_precision, round(brier, 9) AS brier FROM a JOIN ap USING (block)""")
def _(spark, d):
    return rounded(E.rank_auc(T.scores(spark, d), ["block"]), "auc", "average_precision", "brier")


@query("best_threshold", T.with_("scores") + """
, t AS (SELECT block, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM scores GROUP BY block, score),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER b AS p, sum(neg) OVER b AS n FROM t WINDOW w AS (PARTITION BY block ORDER BY score DESC), b AS (PARTITION BY block)),
s AS (SELECT block, score, 0 AS o, 'gt' AS direction, tp - pos AS tp, fp - neg AS fp, p FROM u UNION ALL SELECT block, score, 1, 'lt', p - tp, n - fp, p FROM u),
k AS (SELECT *, 2.0::DOUBLE * tp / (tp + fp + p) AS f1, row_number() OVER (PARTITION BY block ORDER BY 2.0::DOUBLE * tp / (tp + fp + p) DESC, score, o) AS rank FROM s WHERE tp > 0)
SELECT block, score AS threshold, direction, round(f1, 9) AS f1, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM k WHERE rank = 1""")
def _(spark, d):
    return rounded(E.best_threshold(T.scores(spark, d), ["block"]), "f1", "precision", "recall")


@query("separability", T.with_("scores") + """
, s AS (SELECT block, avg(score) FILTER (WHERE label = 1) AS mean_1, avg(score) FILTER (WHERE label <> 1) AS mean_0, var_pop(score) FILTER (WHERE label = 1) AS v1, var_pop(score) FILTER (WHERE label <> 1) AS v0,
  avg((score > 0)::INT::DOUBLE) FILTER (WHERE label = 1) AS share_1, avg((score > 0)::INT::DOUBLE) FILTER (WHERE label <> 1) AS share_0 FROM scores GROUP BY block)
SELECT block, round(mean_1, 9) AS mean_1, round(mean_0, 9) AS mean_0, round(share_1, 9) AS share_1, round(share_0, 9) AS share_0, round((mean_1 - mean_0) * (mean_1 - mean_0) / greatest(v1 + v0, 1e-9), 9) AS fisher FROM s""")
def _(spark, d):
    return rounded(E.separability(T.scores(spark, d), ["block"]), "mean_1", "mean_0", "share_1", "share_0", "fisher")


@query("tier_table", T.with_("scores") + """
, t AS (SELECT CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'elevated' WHEN score >= 0.3 THEN 'watch' ELSE 'informational' END AS tier, CASE WHEN score >= 0.7 THEN 4 WHEN score >= 0.5 THEN 3 WHEN score >= 0.3 THEN 2 ELSE 1 END AS k, label FROM scores),
a AS (SELECT tier, k, count(*) AS n, count(*) FILTER (WHERE label = 1) AS events FROM t GROUP BY tier, k)
SELECT tier, n, events, round(events / n, 9) AS rate, coalesce(events / n >= lag(events / n) OVER (ORDER BY k), true) AS rises FROM a""")
def _(spark, d):
    return rounded(E.tier_table(T.scores(spark, d), (0.3, 0.5, 0.7)), "rate")


@query("boundary_metrics", T.with_("scores") + """
, c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label <> 1 AND score < 0.5) AS tn FROM scores)
SELECT round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS false_alarms, round(tp / nullif(tp + fp, 0), 9) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, fn AS missed FROM c""")
def _(spark, d):
    return rounded(E.boundary_metrics(T.scores(spark, d), 0.5), "recall", "false_alarms", "precision", "f1")


@query("threshold_at_far", T.with_("scores") + """
, q AS (SELECT block, quantile_cont(score, 0.9) FILTER (WHERE label <> 1) AS threshold FROM scores GROUP BY block)
SELECT block, round(threshold, 9) AS threshold, round(count(*) FILTER (WHERE label = 1 AND score >= threshold) / nullif(count(*) FILTER (WHERE label = 1), 0), 9) AS recall, round(count(*) FILTER (WHERE label <> 1 AND score >= threshold) / nullif(count(*) FILTER (WHERE label <> 1), 0), 9) AS false_alarms
FROM scores JOIN q USING (block) GROUP BY block, threshold""")
def _(spark, d):
    return rounded(E.threshold_at_far(T.scores(spark, d), ["block"], 0.1), "threshold", "recall", "false_alarms")


@query("leave_one_scene_out", T.with_("scores") + """
, e AS (SELECT block, abs(score - label) AS e FROM scores),
m AS (SELECT DISTINCT block AS held FROM e),
n AS (SELECT held, count(*) AS n FROM m JOIN e ON e.block <> held GROUP BY held),
q AS (SELECT held, quantile_cont(e, 0.9) AS q0, list(e ORDER BY e) AS l, count(*) AS n FROM m JOIN e ON e.block <> held GROUP BY held),
p AS (SELECT held, l, least(ceil((n + 1) * 0.9::DOUBLE) / n, 1.0) * (n - 1) AS pos FROM q),
v AS (SELECT held AS block, l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS q FROM p)
SELECT block, round(q, 9) AS q, round(count(*) FILTER (WHERE e <= q) / count(*), 9) AS coverage, abs(count(*) FILTER (WHERE e <= q) / count(*) - 0.9) <= 0.05 AS passed FROM v JOIN e USING (block) GROUP BY block, q""")
def _(spark, d):
    return rounded(E.conformal_quantiles(T.scores(spark, d), "block", 0.1), "q", "coverage")


@query("ape_summary", T.with_("surveys") + """
, s AS (SELECT lake_type, abs(0.104 * pow(area_km2 * 1e6, 1.421) - volume_m3) / volume_m3 AS ape FROM surveys WHERE volume_m3 > 0)
SELECT lake_type, count(*) AS n, round(avg(ape), 6) AS mean_ape, round(median(ape), 6) AS median_ape, avg(ape) < 0.15 AS passed FROM s GROUP BY ROLLUP (lake_type)""")
def _(spark, d):
    s = T.surveys(spark, d).select("lake_type", F.col("volume_m3").alias("truth"), (0.104 * F.pow(F.col("area_km2") * 1e6, F.lit(1.421))).alias("estimate"))
    return rounded(E.ape_summary(s, "lake_type"), "mean_ape", "median_ape", digits=6)


@query("distribution_stats", T.with_("scores") + "SELECT label, count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(quantile_cont(score, 0.05), 9) AS p05, round(median(score), 9) AS p50, round(quantile_cont(score, 0.95), 9) AS p95 FROM scores GROUP BY label")
def _(spark, d):
    return rounded(E.distribution_stats(T.scores(spark, d), ["label"], "score"), "mean", "std", "p05", "p50", "p95")


@query("shadow_summary", T.with_("scores") + """
, a AS (SELECT avg((score - label) * (score - label)) FILTER (WHERE block <> 4) AS brier, avg(score) FILTER (WHERE block <> 3) AS p, avg(0.2 + score / 4) AS width, avg((score >= 0.7)::INT::DOUBLE) AS triggered, avg((block <> 2)::INT::DOUBLE) AS evidence FROM scores)
SELECT 'brier' AS metric, round(brier, 9) AS value, 0.15::DOUBLE AS gate, brier < 0.15 AS passed FROM a UNION ALL SELECT 'p', round(p, 9), NULL, NULL FROM a UNION ALL SELECT 'width', round(width, 9), NULL, NULL FROM a UNION ALL SELECT 'iou', NULL, 0.65, NULL
UNION ALL SELECT 'triggered', round(triggered, 9), NULL, NULL FROM a UNION ALL SELECT 'evidence', round(evidence, 9), NULL, NULL FROM a UNION ALL SELECT 'overall', NULL, NULL, coalesce(brier < 0.15, false) FROM a""")
def _(spark, d):
    p, block = F.col("score"), F.col("block")
    s = T.scores(spark, d).select(
        F.when(block != 4, (p - F.col("label")) * (p - F.col("label"))).alias("brier"), F.when(block != 3, p).alias("p"), (0.2 + p / 4).alias("width"), F.lit(None).cast("double").alias("iou"), (p >= 0.7).alias("triggered"), (block != 2).alias("evidence")
    )
    return rounded(E.shadow_summary(s), "value")


@query("fold_summary", "SELECT " + ", ".join(f"round({f}({n}), 6) AS {n}_{x}" for n in ("auc", "average_precision", "brier") for x, f in (("mean", "avg"), ("std", "stddev_pop"))) + f" FROM ({ORACLE_SQL['rank_auc']})")
def _(spark, d):
    names = ["auc", "average_precision", "brier"]
    out = E.over_folds(E.rank_auc(T.scores(spark, d), ["block"]), names)
    return rounded(out, *out.columns, digits=6)


@query("recall_at_false_alarms", T.with_("scores") + f"""
, q AS ({" UNION ALL ".join(f"SELECT block, {f}::DOUBLE AS share, quantile_cont(score, {1 - f}) FILTER (WHERE label <> 1) AS t FROM scores WHERE sample_id % 2 = 0 GROUP BY block" for f in (0.01, 0.05, 0.1))}),
c AS (SELECT block, share, count(*) FILTER (WHERE label = 1) AS events, count(*) FILTER (WHERE label <> 1) AS others, count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label <> 1 AND score >= t) AS fp FROM scores JOIN q USING (block) WHERE sample_id % 2 = 1 AND t IS NOT NULL GROUP BY block, share)
SELECT share, count(*) AS folds, round(avg(tp / events), 9) AS mean_recall, round(avg(fp / others), 9) AS mean_false_alarms, round(sum(tp) / sum(events), 9) AS recall, round(sum(fp) / sum(others), 9) AS false_alarms FROM c WHERE events > 0 AND others > 0 GROUP BY share""")
def _(spark, d):
    s = T.scores(spark, d)
    return rounded(E.recall_at_false_alarms(s.where("sample_id % 2 = 0"), s.where("sample_id % 2 = 1"), "block", (0.01, 0.05, 0.1)), "mean_recall", "mean_false_alarms", "recall", "false_alarms")


@query("conformal_summary", T.with_("scores") + f"""
, e AS (SELECT abs(score - label) AS e FROM scores), n AS (SELECT count(*) AS n, list(e ORDER BY e) AS l FROM e),
p AS (SELECT l, least(ceil((n + 1) * 0.9::DOUBLE) / n, 1.0) * (n - 1) AS pos FROM n),
v AS (SELECT l[floor(pos)::INT + 1] + (l[ceil(pos)::INT + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS q FROM p),
g AS (SELECT count(*) AS groups, min(coverage) AS least, max(coverage) AS largest, bool_and(passed) AND count(*) >= 3 AS passed FROM ({ORACLE_SQL["leave_one_scene_out"]}))
SELECT round(q, 9) AS q, round((SELECT avg((e <= q)::INT::DOUBLE) FROM e), 9) AS coverage, g.* FROM v, g""")
def _(spark, d):
    return rounded(E.conformal_summary(T.scores(spark, d), "block", 0.1), "q", "coverage", "least", "largest")


_GATED = T.with_("cells") + """
, g AS (SELECT (r % 6)::INT AS pair, CASE WHEN r % 6 = 5 THEN 'frozen' ELSE 'unfrozen' END AS season, least(1.0, coalesce(b, 0) / 20) AS p0, least(1.0, a / 60) AS p1, coalesce(b, 0) > 12 AS water0, a + c % (r % 6 + 2) > 26 AS water1, c % 13 <> 0 AS valid0, c % 11 <> 0 AS valid1,
  c BETWEEN 20 AND 80 AS roi, c > 5 AS aoi, c % 17 = 3 AS glacier, c BETWEEN 30 AND 70 AS vicinity, r % 19 = 4 AS steep FROM cells),
t AS (SELECT unnest([0.3, 0.4, 0.5, 0.55])::DOUBLE AS tau),
m AS (SELECT *, NOT aoi OR steep OR (glacier AND NOT vicinity) AS barred, roi AND valid1 AS region, roi AND valid0 AND valid1 AS span, water1 AND NOT water0 AS labelled FROM g),
x AS (SELECT *, p1 >= tau AND NOT barred AS now, p0 >= tau AND NOT barred AS before, p1 >= 0.5 AND p1 - p0 >= 0.2 AND span AS up FROM m, t),
k AS (SELECT pair, season, tau, count(*) FILTER (WHERE region) AS region, count(*) FILTER (WHERE water1 AND region) AS label, count(*) FILTER (WHERE up) AS risen, count(*) FILTER (WHERE up AND labelled) AS risen_tp, count(*) FILTER (WHERE up AND NOT water1) AS risen_fp,
  count(*) FILTER (WHERE labelled AND span) AS label_change, count(*) FILTER (WHERE now AND water1 AND region) AS i, count(*) FILTER (WHERE (now OR water1) AND region) AS u, count(*) FILTER (WHERE now AND region) AS predicted, count(*) FILTER (WHERE p1 >= tau AND water1 AND region) AS found,
  count(*) FILTER (WHERE now AND NOT before AND span) AS expansion, count(*) FILTER (WHERE now AND NOT before AND span AND labelled) AS expansion_tp, count(*) FILTER (WHERE now AND NOT before AND span AND NOT water1) AS expansion_fp,
  count(*) FILTER (WHERE now AND glacier AND NOT vicinity AND aoi) AS ice_cells, count(*) FILTER (WHERE now AND aoi) AS water_cells FROM x GROUP BY pair, season, tau),
r AS (SELECT *, round(i / nullif(u, 0), 4) AS iou, round(i / nullif(predicted, 0), 4) AS precision, round(found / nullif(label, 0), 4) AS recall, round(ice_cells / nullif(water_cells, 0), 4) AS ice, round(predicted / nullif(region, 0), 4) AS water FROM k),
f AS (SELECT * EXCLUDE (i, u, found), coalesce(CASE WHEN season = 'unfrozen' THEN iou >= 0.6 AND precision >= 0.84 ELSE predicted / nullif(region, 0) <= 0.1 END AND ice < 0.05, false) AS passed FROM r)
"""


def _gates(spark, d):
    r, c, b = F.col("r"), F.col("c"), F.coalesce("b", F.lit(0.0))
    cells = T.cells(spark, d).select(
        (r % 6).cast("int").alias("pair"), F.when(r % 6 == 5, "frozen").otherwise("unfrozen").alias("season"), F.least(F.lit(1.0), b / 20).alias("p0"), F.least(F.lit(1.0), F.col("a") / 60).alias("p1"),
        (b > 12).alias("water0"), (F.col("a") + c % (r % 6 + 2) > 26).alias("water1"), (c % 13 != 0).alias("valid0"), (c % 11 != 0).alias("valid1"), c.between(20, 80).alias("roi"), (c > 5).alias("aoi"),
        (c % 17 == 3).alias("glacier"), c.between(30, 70).alias("vicinity"), (r % 19 == 4).alias("steep"),
    )
    return E.scene_gate(cells, (0.3, 0.4, 0.5, 0.55))


@query("scene_gate", _GATED + "SELECT * FROM f")
def _(spark, d):
    return _gates(spark, d)


@query("scene_verdict", _GATED + """
SELECT count(*) AS pairs, count(*) FILTER (WHERE s) AS in_scope, count(*) FILTER (WHERE s AND passed) AS passed, count(*) FILTER (WHERE s AND passed) >= 2 AS eligible
FROM (SELECT passed, pair % 4 <> 3 AND season = 'unfrozen' AS s FROM f WHERE tau = 0.3::DOUBLE)""")
def _(spark, d):
    gates = _gates(spark, d)
    pairs = gates.select("pair", ((F.col("pair") % 4 != 3) & (F.col("season") == "unfrozen")).alias("in_scope")).distinct()
    return E.scene_verdict(pairs, gates, 0.3)


@query("splits", T.with_("scores") + ", o AS (SELECT block, count(*) AS test FROM scores GROUP BY block) SELECT block, test, (sum(test) OVER () - test)::BIGINT AS train FROM o")
def _(spark, d):
    return E.leave_one_out(T.scores(spark, d), "block")


@query("event_metrics", T.with_("scores") + """
, c AS (SELECT block AS event, (sample_id % 3)::INT AS chip, label = 1 AS truth, score >= 0.4 AS before, score >= 0.4 AND sample_id % 7 <> 0 AS after FROM scores),
a AS (SELECT event, chip, count(*) FILTER (WHERE truth AND before) AS t0, count(*) FILTER (WHERE NOT truth AND before) AS f0, count(*) FILTER (WHERE truth AND NOT before) AS n0, count(*) FILTER (WHERE truth AND after) AS t1, count(*) FILTER (WHERE NOT truth AND after) AS f1, count(*) FILTER (WHERE truth AND NOT after) AS n1 FROM c GROUP BY ROLLUP (event, chip))
SELECT event, chip, round(coalesce(t1 / nullif(t1 + f1 + n1, 0), 0) - coalesce(t0 / nullif(t0 + f0 + n0, 0), 0), 9) AS iou_gain, f0 - f1 AS fp_removed, t0 - t1 AS tp_removed FROM a""")
def _(spark, d):
    s = T.scores(spark, d).select(F.col("block").alias("event"), (F.col("sample_id") % 3).cast("int").alias("chip"), (F.col("label") == 1).alias("truth"), (F.col("score") >= 0.4).alias("before"), ((F.col("score") >= 0.4) & (F.col("sample_id") % 7 != 0)).alias("after"))
    return rounded(E.event_metrics(s, "event", "chip"), "iou_gain")


@query("overlap_check", T.with_("cells") + """
, o AS (SELECT count(*) FILTER (WHERE a > 60 AND b > 40) AS overlap, count(*) FILTER (WHERE a > 60) AS model_cells, count(*) FILTER (WHERE b > 40) AS rule_cells FROM cells)
SELECT *, round(overlap / nullif(rule_cells, 0), 9) AS rule_recall, round(overlap / nullif(model_cells, 0), 9) AS model_precision, (model_cells = 0) <> (rule_cells = 0) OR coalesce(overlap / nullif(rule_cells, 0) < 0.5, false) OR coalesce(overlap / nullif(model_cells, 0) < 0.5, false) AS material FROM o""")
def _(spark, d):
    return rounded(E.overlap_check(T.cells(spark, d), F.col("a") > 60, F.col("b") > 40), "rule_recall", "model_precision")
