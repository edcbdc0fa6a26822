"""Fitted artifacts as versions on shared storage: models, calibrator, preprocessing and rule.

A version is a folder of tables and Spark ML models. A row of the manifest table, written last, says
what belongs to it, so a version that failed half way is never seen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import binary_entropy
from . import conformal, isotonic, models, selection

_MANIFEST = (
    "version long, modelled array<string>, features array<string>, names array<string>, "
    "numeric array<struct<name:string,median:double,mean:double,deviation:double>>, "
    "categorical array<struct<name:string,mode:string,kept:array<string>,rare:boolean>>, "
    "members array<long>, calibrator string, parameters map<string,double>, rule_keys array<string>"
)


@dataclass(frozen=True)
class Bundle:
    """Everything a scoring job needs. ``rule`` is a conformal rule, per group of ``rule_keys`` if
    there are any."""

    preprocessor: models.Preprocessor
    members: Mapping[int, models.RiskModel]
    calibrator: object
    rule: DataFrame
    rule_keys: tuple[str, ...] = ()

    @property
    def modelled(self) -> tuple[str, ...]:
        return (*self.preprocessor.numeric, *self.preprocessor.categorical)

    def predict(self, records: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean of the members, their spread (deviation and variance over the members), the entropy
        of the mean and the calibrated probability ``p``, in one scan of the records."""
        if not self.members:
            raise ValueError("the bundle holds no fitted member")
        scored = self.preprocessor.transform(records, keep)
        for seed, member in self.members.items():
            scored = member.score(scored, f"__p_{seed}")
        each = [F.col(f"__p_{seed}") for seed in self.members]
        n = float(len(each))
        mean = sum(each[1:], each[0]) / n
        spread = sum(((c - mean) * (c - mean) for c in each[1:]), (each[0] - mean) * (each[0] - mean)) / n
        found = scored.select(
            *keep, mean.alias("raw_score"), spread.alias("epistemic_variance"),
            F.sqrt(spread).alias("epistemic_std"), F.lit(len(each)).alias("n_members"))
        found = found.withColumn("predictive_entropy", binary_entropy(F.col("raw_score")))
        return self.calibrator.transform(found, "raw_score", "p")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``, oldest first."""
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
        return sorted(r.version for r in manifest.select("version").collect())  # one row per version
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def save(bundle: Bundle, path: str) -> int:
    """Store the bundle as a new version; the number of that version."""
    spark = bundle.rule.sparkSession
    version = max(versions(spark, path), default=0) + 1
    folder = f"{path}/version-{version}"
    bundle.rule.write.parquet(f"{folder}/rule")  # fails if another job is writing this version
    for seed, member in bundle.members.items():
        member.model.write().save(f"{folder}/member-{seed}")
    prep = bundle.preprocessor
    for i, name in enumerate(prep.categorical):
        if name in prep.rare:
            prep.rare[name].write.parquet(f"{folder}/rare-{i}")
    calibrator = bundle.calibrator
    parameters: dict[str, float] = {}
    if isinstance(calibrator, isotonic.IsotonicCalibrator):
        calibrator.knots.write.parquet(f"{folder}/knots")
        parameters = {"count": float(calibrator.count)}
    else:
        parameters = {k: float(v) for k, v in vars(calibrator).items()}
    features = next(iter(bundle.members.values())).features if bundle.members else ()
    row = (version, list(bundle.modelled), list(features), list(prep.names),
           [(n, *map(float, v)) for n, v in prep.numeric.items()],
           [(n, mode, list(kept), rare) for n, (mode, kept, rare) in prep.categorical.items()],
           [int(s) for s in bundle.members], type(calibrator).__name__, parameters, list(bundle.rule_keys))
    spark.createDataFrame([row], _MANIFEST).write.mode("append").parquet(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> Bundle:
    """The bundle of a version, the newest by default. A missing one is an error that says so."""
    known = versions(spark, path)
    version = version if version is not None else max(known, default=None)
    if version not in known:
        raise FileNotFoundError(f"no complete version {version or ''} of fitted artifacts below {path}; "
                                f"found {known}: fit and save first")
    row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").filter(
        F.col("version") == version).first()
    folder = f"{path}/version-{version}"
    rare = {c.name: spark.read.parquet(f"{folder}/rare-{i}") for i, c in enumerate(row.categorical) if c.rare}
    prep = models.Preprocessor(
        {n.name: (n.median, n.mean, n.deviation) for n in row.numeric},
        {c.name: (c["mode"], tuple(c.kept), c.rare) for c in row.categorical}, rare, tuple(row.names))
    members = {s: models.RiskModel(GBTClassificationModel.load(f"{folder}/member-{s}"), tuple(row.features))
               for s in row.members}
    if row.calibrator == "IsotonicCalibrator":
        calibrator = isotonic.IsotonicCalibrator(
            spark.read.parquet(f"{folder}/knots"), int(row.parameters["count"]))
    else:
        kinds = {c.__name__: c for c in (models.PlattCalibrator, models.TemperatureCalibrator)}
        calibrator = kinds[row.calibrator](**row.parameters)
    return Bundle(prep, members, calibrator, spark.read.parquet(f"{folder}/rule"), tuple(row.rule_keys))


def score_requests(
    records: DataFrame, bundle: Bundle, request: str, item: str, min_items: int = 0,
    max_items: int | None = None, min_completeness: float = 0.5, fallback_rate: float = 0.90,
) -> tuple[DataFrame, DataFrame]:
    """Score many requests in one job: one row per candidate and one decision per request.

    Modelled columns that the records lack count as missing values.
    """
    keys = [k for k in bundle.rule_keys if k not in (request, item)]
    absent = [c for c in bundle.modelled if c not in records.columns]
    filled = records.withColumns({c: F.lit(None).cast(
        "double" if c in bundle.preprocessor.numeric else "string") for c in absent})
    scored = bundle.predict(filled, [request, item, *keys])
    chosen = conformal.apply_conformal(scored, bundle.rule, "p", bundle.rule_keys)
    final = selection.apply_budget(chosen, [request], "selected", "p", [item], min_items, max_items)
    completeness = conformal.feature_completeness(records, request, bundle.modelled, min_completeness)
    summary = final.groupBy(request).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("final_selected").alias("n_selected"),
        F.max("capped").alias("budget_capped"), F.max("epistemic_std").alias("max_uncertainty"),
        F.avg("epistemic_std").alias("mean_uncertainty")).join(completeness, request)
    summary = summary.withColumn("guarantee_holds", ~F.col("budget_capped"))
    return final, conformal.request_decision(summary, fallback_rate=fallback_rate)
