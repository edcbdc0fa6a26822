"""Registered queries: Spark ML jobs over rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts, conformal, metrics, models, selection
from ..operators.models import ModelConfig
from ..session import materialise, scratch_folder
from .catalog import Tables, query, r, sql

# A label that depends on two of the features, so that a model has something to find.
_ROWS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_suppkey % 3 AS repo,
    l_quantity AS hist_rate, CASE WHEN l_linenumber <> 4 THEN l_discount END AS hist_recent,
    l_tax AS diff_churn, CAST(l_linenumber AS DOUBLE) AS diff_files, l_extendedprice AS dep_depth,
    l_returnflag AS flag, l_shipdate AS ts,
    CASE WHEN (l_partkey * 7 + l_orderkey * 13) % 100 < l_quantity * 0.5 + l_discount * 200 THEN 1
         ELSE 0 END AS label FROM lineitem"""
_FEATURES = ["hist_rate", "hist_recent", "diff_churn", "diff_files", "dep_depth"]
_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_SMALL = ModelConfig(trees=4, depth=3)


def _rows(t: Tables):
    filled = t.select(_ROWS, "lineitem").withColumn(
        "hist_recent", F.coalesce("hist_recent", F.lit(0.0)))
    side = F.when(F.col("l_suppkey") % 10 < 7, "train").when(
        F.col("l_suppkey") % 10 < 8, "val").otherwise("test")
    return filled.withColumn("split", side)


def _sides(t: Tables):
    rows = _rows(t)
    return [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]


_SCALED = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (coalesce({c}, md) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS v
        FROM x, (SELECT md, avg(coalesce({c}, md)) AS mu, stddev_pop(coalesce({c}, md)) AS sd FROM x,
                 (SELECT quantile_cont({c}, 0.5) AS md FROM x WHERE l_suppkey % 10 < 7) m
                 WHERE l_suppkey % 10 < 7 GROUP BY md) f""" for c in _FEATURES)


@query("fit_preprocessor", "K1", f"""
    WITH x AS ({_ROWS}),
    n AS (SELECT flag, count(*) AS n FROM x WHERE l_suppkey % 10 < 7 GROUP BY flag),
    k AS (SELECT flag, CASE WHEN n >= 0.01 * (SELECT sum(n) FROM n) THEN flag ELSE 'infrequent' END AS name FROM n),
    levels AS (SELECT DISTINCT name FROM k),
    hot AS (SELECT concat('flag_', l.name) AS feature, CAST(l.name IS NOT DISTINCT FROM k.name AS INT) AS v
            FROM x LEFT JOIN k USING (flag), levels l),
    v AS ({_SCALED} UNION ALL SELECT feature, v FROM hot)
    SELECT feature, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max
    FROM v GROUP BY feature""")
def _(t: Tables):
    raw = t.select(_ROWS, "lineitem")
    fitted = models.fit_preprocessor(raw.filter("l_suppkey % 10 < 7"), _FEATURES, ["flag"])
    out = fitted.transform(raw, _ID)
    return metrics.describe_features(out, list(fitted.names))


@query("preprocessor_numbers", "K1", f"""
    WITH x AS ({_ROWS}), m AS (SELECT quantile_cont(hist_recent, 0.5) AS md FROM x),
    f AS (SELECT coalesce(hist_recent, md) AS v FROM x, m),
    s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM f)
    SELECT {r('sum(((v - mu) / sd) * ((v - mu) / sd)) / count(*)')} AS variance, {r('min((v - mu) / sd)')} AS low,
           {r('max((v - mu) / sd)')} AS high FROM f, s""")
def _(t: Tables):
    raw = t.select(_ROWS, "lineitem")
    out = models.fit_preprocessor(raw, ["hist_recent"]).transform(raw, ["l_orderkey"])
    v = F.col("hist_recent")
    return out.agg(F.avg(v * v).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("fit_risk_model", "K2")
def _(t: Tables):
    train, val, _test = _sides(t)
    model = models.fit_risk_model(train, val, _FEATURES, "label", _SMALL)
    return models.model_report(model.score(_rows(t)), "split", "label", "raw_score")


@query("model_importances", "K2 G3")
def _(t: Tables):
    train, val, _test = _sides(t)
    model = models.fit_risk_model(train, val, _FEATURES, "label", _SMALL)
    return selection.top_features(model.importances(train), 20)


@query("fit_ensemble", "K3 E23")
def _(t: Tables):
    train, _val, test = _sides(t)
    members = models.fit_ensemble(train, None, _FEATURES, "label", [1, 2, 3], _SMALL)
    predictions = models.ensemble_predictions(members, test, _ID)
    return models.ensemble_diagnostics(predictions, _ID)


def _labelled(t: Tables):
    return t.scored.withColumn("y", F.when(
        (F.col("test_id") * 7 + F.col("l_orderkey") * 13) % 100 < F.col("p") * 60, 1).otherwise(0))


def _calibrate(fit):
    def build(t: Tables):
        rows = _labelled(t)
        half = F.col("l_orderkey") % 2
        fitted = fit(rows.filter(half == 0), "y", "p")
        held = fitted.transform(rows.filter(half == 1), "p", "q")
        return metrics.one_row(
            metrics.calibration_error(held, "y", "p", 15).select(F.col("ece").alias("ece_before")),
            metrics.calibration_error(held, "y", "q", 15).select(F.col("ece").alias("ece_after")),
            metrics.probability_losses(held, "y", "q"))

    return build


query("fit_platt", "K4")(_calibrate(models.fit_platt))


@query("fit_isotonic", "K5", sql(f"""
    WITH x AS (SELECT l_orderkey, p, CASE WHEN (test_id * 7 + l_orderkey * 13) % 100 < p * 60 THEN 1 ELSE 0 END AS y
               FROM scored),
    u AS (SELECT p, count(*) AS w, sum(y) AS s FROM x WHERE l_orderkey % 2 = 0 GROUP BY p),
    c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(w) OVER (ORDER BY p) AS cw,
                 sum(s) OVER (ORDER BY p) AS cs, w, s FROM u),
    spans AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean
              FROM c a JOIN c b ON a.i <= b.i),
    ends AS (SELECT t.i, s.b, max(s.mean) AS top FROM c t JOIN spans s ON s.a <= t.i AND s.b >= t.i GROUP BY 1, 2),
    fit AS (SELECT c.p, least(greatest(min(top), 0), 1) AS q FROM ends JOIN c USING (i) GROUP BY c.p)
    SELECT {r('p')} AS p, {r('q')} AS q, count(*) AS n FROM x JOIN fit USING (p) WHERE l_orderkey % 2 = 1 GROUP BY ALL""",
    "scored"))
def _(t: Tables):
    """The largest mean of stretches that begin at or before a score, made smallest over their ends."""
    rows = _labelled(t)
    half = F.col("l_orderkey") % 2
    fitted = models.fit_isotonic(rows.filter(half == 0), "y", "p")
    held = rows.filter(half == 1).join(rows.filter(half == 0).select("p").distinct(), "p", "left_semi")
    return fitted.transform(held, "p", "q").groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


query("isotonic_report", "K5")(_calibrate(models.fit_isotonic))
query("fit_temperature", "K6")(_calibrate(models.fit_temperature))


@query("cross_check_platt", "K4")
def _(t: Tables):
    return models.cross_check_platt(t.scored, "label", "p", [
        "commit_sha", "test_id", "l_orderkey", "l_linenumber"], folds=3)


@query("tune_models", "K7 G5")
def _(t: Tables):
    train, val, _test = _sides(t)
    return selection.best_candidate(models.tune_models(train, val, _FEATURES, "label"))


@query("calibration_job", "K8")
def _(t: Tables):
    rows = t.scored.select("l_orderkey", "label", "p")
    table, _chosen = models.calibration_job(
        rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1"), "l_orderkey",
        "label", "p")
    return table


@query("lopo", "K9 E27")
def _(t: Tables):
    results = models.lopo(_rows(t).drop("split"), "repo", "l_suppkey", _FEATURES, "label", _ID)
    return metrics.macro_average(results, ["pr_auc", "roc_auc", "ece", "recall"])


@query("ablation", "K10")
def _(t: Tables):
    train, val, test = _sides(t)
    return models.ablation(train, val, test, {
        "hist": ["hist_rate", "hist_recent"], "other": ["diff_churn", "diff_files", "dep_depth"]},
        "label", ModelConfig(trees=2, depth=2))


@query("noise_stress", "K11 E22")
def _(t: Tables):
    train, val, test = _sides(t)
    return models.noise_stress(train, val, test, _FEATURES, "label", "l_suppkey", _ID, [0.05],
                               config=ModelConfig(trees=2, depth=2))


@query("reduce_embeddings", "K12")
def _(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding")
    return models.reduce_embeddings(rows, "vec_id", "embedding", 4)


def _bundle(t: Tables):
    """Fit on six tenths of the suppliers, calibrate on one, save, and load as a scoring job would."""
    raw = t.select(_ROWS, "lineitem")
    train, held = raw.filter("l_suppkey % 10 < 6"), raw.filter("l_suppkey % 10 = 6")
    prep = models.fit_preprocessor(train, _FEATURES, ["flag"])
    members = models.fit_ensemble(prep.transform(train, ["label"]), None, prep.names, "label", [1, 2],
                                  ModelConfig(trees=5, depth=3))
    draft = artifacts.Bundle(prep, members, models.PlattCalibrator(1.0, 0.0), held)
    raw_scores = materialise(draft.predict(held, ["label"]).select("label", "raw_score"))
    platt = models.fit_platt(raw_scores, "label", "raw_score")
    rule = conformal.conformal_threshold(platt.transform(raw_scores, "raw_score", "p"), "label", "p")
    folder = scratch_folder(t.spark)
    artifacts.save(artifacts.Bundle(prep, members, platt, rule), folder)
    requests = raw.filter("l_suppkey % 10 > 6").select(
        F.col("l_suppkey").alias("request"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in _ID]).alias("item"), *_FEATURES, "flag")
    return requests, artifacts.load(t.spark, folder)


@query("score_requests", "K13 K3 J5")
def _(t: Tables):
    requests, bundle = _bundle(t)
    _items, decisions = artifacts.score_requests(requests, bundle, "request", "item", 5, 550)
    return decisions


_ATTRIBUTIONS = " UNION ALL ".join(
    f"SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
    f"CAST(l_linenumber AS STRING)) AS row_id, '{name}' AS feature, {value} AS attribution FROM lineitem"
    for name, value in (("quantity", "l_quantity - 25"), ("discount", "l_discount * 1000 - 50"),
                        ("tax", "30 - l_tax * 1000"), ("line", "l_linenumber * 5.0 - 20"),
                        ("price", "l_extendedprice / 1000 - 40")))


@query("attribution_topk", "K14", f"""
    WITH a AS ({_ATTRIBUTIONS}),
    k AS (SELECT *, CASE WHEN attribution > 0 THEN 'INCREASES_RISK' ELSE 'DECREASES_RISK' END AS impact,
          row_number() OVER (PARTITION BY row_id, attribution > 0 ORDER BY abs(attribution) DESC, feature) AS rank
          FROM a WHERE attribution <> 0)
    SELECT row_id, feature, {r('attribution')} AS attribution, impact, rank FROM k WHERE rank <= 2""")
def _(t: Tables):
    rows = t.select(_ATTRIBUTIONS, "lineitem")
    return models.attribution_topk(rows, "row_id", 2)


@query("attribution_ranking", "K14", f"""
    SELECT feature, {r('avg(abs(attribution))')} AS mean_abs FROM ({_ATTRIBUTIONS}) a GROUP BY feature""")
def _(t: Tables):
    return models.attribution_ranking(t.select(_ATTRIBUTIONS, "lineitem"))
