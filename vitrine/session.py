"""SparkSession helpers.

On a cluster the session comes from the launcher; ``get_session`` only fills in
settings that are unset, so cluster-wide values (shuffle partitions, checkpoint
directory, broadcast threshold) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (the only
# place a side is broadcast is below ``autoBroadcastJoinThreshold``, a size Spark
# measures) and splits skewed shuffle partitions of sort-merge joins. These are
# runtime SQL settings: applied only when the session has no value for them.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Launch settings for sessions this helper starts itself (local runs and tests):
# no web UI, no console progress bar, checkpoint files removed once unreferenced.
LAUNCH_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
DEFAULTS = {**SQL_DEFAULTS, **LAUNCH_DEFAULTS}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vitrine") -> SparkSession:
    """The active session, or a new one; never overrides a value already set."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        for key, value in LAUNCH_DEFAULTS.items():
            builder = builder.config(key, value)
        builder = builder.config("spark.driver.memory", os.environ.get("VITRINE_DRIVER_MEMORY", "16g"))
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if shuffle_partitions and spark.conf.get("spark.sql.shuffle.partitions", None) is None:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone; without
    it a cluster session is refused, since a folder of one machine is lost to the
    others. Only a local session (tests) gets a scratch directory of its own.
    """
    current = spark.sparkContext.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if current and not path:
        return current
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vitrine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not current:
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that several later steps read.

    A reliable checkpoint is written once to the shared ``spark.checkpoint.dir``;
    later steps read it instead of recomputing the scans and joins behind it,
    and a lost executor does not force that recomputation either.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
