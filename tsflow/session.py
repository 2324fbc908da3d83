"""Session helpers.

On a cluster the session is created by the platform; ``checkpoint_dir`` only
fills ``spark.checkpoint.dir`` when nobody set it (tests, local runs).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours needs for correct results (UTC calendar math,
# no implicit float->int truncation surprises) and for scale (AQE re-plans
# shuffles, coalesces small partitions and splits skewed join partitions).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "tsflow", extra: dict | None = None) -> SparkSession:
    """A session with the settings above.  ``shuffle_partitions`` is set only where it is passed
    (tests, local runs); a cluster keeps its own number."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's, else ``spark.checkpoint.dir``.

    Only a local-mode session (tests, one machine) may run without the setting and gets a
    scratch folder; on a cluster a missing setting is an error, since executors could not
    read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tsflow-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a derived table that has several consumers: one reliable checkpoint
    in the shared folder.  A lost executor then costs a re-read, not a recompute."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tsflow-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def store_table(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Write a table as plain parquet under the shared folder and read it back.

    With ``order`` (say series key and position block) the files are range-clustered on these
    columns, so scans prune by them.  The table is not bucketed: a bucketing on the series key
    would let later windows skip the shuffle that splits a hot series into its blocks.
    """
    path = scratch_path(df.sparkSession, name)
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
