"""Structured Streaming jobs: idempotent ingest, event filtering and continual learning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models
from ..session import materialise
from . import drift


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into a Parquet table and stop."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def resume_ingest(
    stream: DataFrame, ids: Sequence[str], event_time: str | None = None,
    lateness: str = "1 day",
) -> DataFrame:
    """Each id once, across restarts: the streaming checkpoint remembers what was taken.

    With an event time the remembered ids are dropped once the watermark passes them, which
    bounds the state of an endless stream.
    """
    if event_time is None:
        return stream.dropDuplicates(list(ids))
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(ids))


# Pull request actions that need a selection.
PULL_ACTIONS = ("opened", "synchronize", "reopened")

_PULL = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("number", T.LongType()),
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
    T.StructField("pull_request", T.StructType([
        T.StructField("number", T.LongType()),
        T.StructField("head", T.StructType([T.StructField("sha", T.StringType())]))])),
])
_RUN = T.StructType([
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
    T.StructField("workflow_run", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("conclusion", T.StringType()),
        T.StructField("html_url", T.StringType()), T.StructField("head_sha", T.StringType()),
        T.StructField("pull_requests", T.ArrayType(T.StructType([
            T.StructField("number", T.LongType())])))])),
])


def pr_event_stream(events: DataFrame, kind: str, body: str) -> DataFrame:
    """Pull request events that need a selection: repository, number and head commit."""
    parsed = events.filter(F.col(kind) == "pull_request").withColumn("__e", F.from_json(body, _PULL))
    kept = parsed.filter(F.col("__e.action").isin(*PULL_ACTIONS))
    return kept.select(
        *[c for c in events.columns if c not in (kind, body)], F.col("__e.action").alias("action"),
        F.coalesce("__e.repository.full_name", F.lit("unknown/repo")).alias("repo"),
        F.coalesce("__e.number", "__e.pull_request.number").alias("number"),
        F.coalesce("__e.pull_request.head.sha", F.lit("HEAD")).alias("head_sha"))


def failed_run_stream(events: DataFrame, kind: str, body: str) -> DataFrame:
    """Failed workflow runs that belong to a pull request."""
    parsed = events.filter(F.col(kind) == "workflow_run").withColumn("__e", F.from_json(body, _RUN))
    run = "__e.workflow_run"
    kept = parsed.filter((F.col(f"{run}.conclusion") == "failure")
                         & (F.size(f"{run}.pull_requests") > 0)
                         & F.contains("__e.repository.full_name", F.lit("/")))
    return kept.select(
        *[c for c in events.columns if c not in (kind, body)],
        F.col("__e.repository.full_name").alias("repo"), F.col(f"{run}.id").alias("run_id"),
        F.col(f"{run}.html_url").alias("run_url"),
        F.coalesce(f"{run}.head_sha", F.lit("")).alias("head_sha"),
        F.get(F.col(f"{run}.pull_requests.number"), F.lit(0)).alias("number"))


class ContinualLearner:
    """Scores each micro-batch, watches its error, keeps a replay table and refits on an alarm.

    All that carries over lies in tables below ``state``, one folder per epoch: the replay buffer, the
    model, and a row with detector and counters, written last. A micro-batch starts from the newest
    complete epoch before its own, and what it writes replaces what a failed attempt at the same
    epoch left behind; so a retry writes nothing twice and a restart goes on where the last run
    ended. The model is refitted between micro-batches, so one commit per micro-batch gives the
    commit-by-commit behaviour.
    """

    _ROW = ("epoch long, mean double, total double, low double, samples long, adaptations long, "
            "model_epoch long")

    def __init__(
        self, seed: DataFrame, features: Sequence[str], label: str, commit: str, position: str, state: str,
        capacity: int = 1000, detector: drift.PageHinkley | None = None,
        config: models.ModelConfig = models.ModelConfig(),
    ) -> None:
        self.features, self.label, self.state = list(features), label, state
        self.commit, self.position = commit, position
        self.capacity, self.config = capacity, config
        self.columns = [commit, position, label, *self.features]
        self.detector = detector or drift.PageHinkley(threshold=10.0)
        self.spark = seed.sparkSession
        if not self._epochs():
            buffer = self._newest(seed.select(*self.columns))
            self._save(-1, buffer, models.fit_risk_model(buffer, None, self.features, label, config),
                       self.detector, 0, -1)

    def _epochs(self) -> list[int]:
        try:
            rows = self.spark.read.schema(self._ROW).parquet(f"{self.state}/epochs")
            return sorted({r.epoch for r in rows.select("epoch").collect()})  # one row per epoch
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = [F.col(self.position).desc(), *[F.col(c).desc() for c in self.features]]
        return materialise(rows.orderBy(*order).limit(self.capacity))

    def _save(self, epoch: int, buffer: DataFrame, model: models.RiskModel | None,
              detector: drift.PageHinkley, adaptations: int, model_epoch: int) -> None:
        buffer.write.mode("overwrite").parquet(f"{self.state}/buffer-{epoch}")
        if model is not None:
            model.model.write().overwrite().save(f"{self.state}/model-{epoch}")
        row = (epoch, detector.mean, detector.total, detector.low, detector.samples, adaptations, model_epoch)
        self.spark.createDataFrame([row], self._ROW).write.mode("overwrite").parquet(
            f"{self.state}/epochs/n={epoch}")

    def step(self, batch: DataFrame, epoch: int) -> DataFrame:
        """Advance over one micro-batch; returns one timeline row per commit."""
        before = max(e for e in self._epochs() if e < epoch)
        row = self.spark.read.parquet(f"{self.state}/epochs/n={before}").first()
        model = models.RiskModel(GBTClassificationModel.load(f"{self.state}/model-{row.model_epoch}"),
                                 tuple(self.features))
        rows = materialise(batch.select(*self.columns))
        errors = drift.commit_errors(
            model.score(rows, "p"), [], self.commit, F.col(self.position), self.label, "p")
        detector = replace(self.detector, mean=row.mean, total=row.total, low=row.low, samples=row.samples)
        traced, detector = drift.follow_stream(errors, ["at", self.commit], "error", detector)
        traced = materialise(traced)
        buffer = self._newest(self.spark.read.parquet(f"{self.state}/buffer-{before}").unionByName(rows))
        fresh, adaptations, model_epoch = None, row.adaptations, row.model_epoch
        if not traced.filter("alarm = 1").isEmpty():
            fresh = models.fit_risk_model(buffer, None, self.features, self.label, self.config)
            adaptations, model_epoch = adaptations + 1, epoch
        self._save(epoch, buffer, fresh, detector, adaptations, model_epoch)
        return traced.select(
            F.col(self.commit).cast("string").alias("commit"), F.col("at").cast("long").alias("position"),
            "error", "statistic", "alarm", F.lit(adaptations).cast("int").alias("adaptations"))

    def run(self, stream: DataFrame, path: str, checkpoint: str) -> None:
        """Consume everything available now; the timeline of an epoch is a folder of its own."""
        def advance(batch: DataFrame, epoch: int) -> None:
            if not batch.isEmpty():
                self.step(batch, epoch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        query = (stream.writeStream.foreachBatch(advance)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()


def replay_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1,
                 pattern: str = "*.parquet", prepare: Callable[[DataFrame], DataFrame] | None = None
                 ) -> DataFrame:
    """A table of files as a stream, a few files per micro-batch."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .option("pathGlobFilter", pattern).parquet(path))
    return stream if prepare is None else prepare(stream)
