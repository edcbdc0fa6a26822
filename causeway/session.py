"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

_PARTITIONS = "spark.sql.shuffle.partitions"
# Settings every job relies on; all of them can be changed on a running session.
_SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators assume to an existing session.

    Functions that run in Python workers are sent by value, so executors need no installed
    copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get(_PARTITIONS, None) in (None, "200"):
        # The cluster default is far too fine for one machine; a cluster keeps its own setting.
        spark.conf.set(_PARTITIONS, str(context.defaultParallelism))
    for name, value in _SQL_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("causeway")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, ahead of work that costs far more per row than reading it.

    A file of many short rows is one split, and so would be the work behind it. Rows are placed by
    what they hold, so a task that runs again deals them out alike.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism,
                int(df.sparkSession.conf.get(_PARTITIONS, "200")))
    places = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.repartition(parts, *places)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )


def _remove_scratch(context: SparkContext, folder: str) -> None:
    if context._jsc is None:
        return  # stopped; nothing can reach the file system any more
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder, removed when the program ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove_scratch, spark.sparkContext, folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Lineage ends at the table: losing an executor costs nothing but a re-read, and later steps
    prune columns. The table is removed when the program ends.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
