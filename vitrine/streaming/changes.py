"""Change sets applied as they arrive, with Structured Streaming.

The reference applies one change per request as requests come in. Here change
files (Parquet, one ``id`` column) landing in a directory are read with
``readStream``; every micro-batch applies its deletes to the latest snapshot
with the same batch job as ``operators.changes`` and writes the next snapshot
version ``<root>/v=<batch id>``. The stream's checkpoint records which files
were consumed, and a version that already has its ``_SUCCESS`` marker is not
written again, so a batch replayed after a failure gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators import changes
from vitrine.sources import schemas
from vitrine.sources.tables import read_snapshot


def _version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version}"


def _committed(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished Spark write (works on any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def latest_version(spark: SparkSession, root: str, before: int) -> str | None:
    for v in range(before - 1, -1, -1):
        p = _version_path(root, v)
        if _committed(spark, p):
            return p
    return None


def start_delete_stream(spark: SparkSession, changes_dir: str, initial_snapshot: str, snapshot_root: str,
                        checkpoint: str, table: str = "products", trigger_once: bool = False) -> StreamingQuery:
    """Soft-delete the ids of every arriving change file from ``table``'s snapshot.

    ``initial_snapshot`` is the snapshot before the first batch; versions are
    written under ``snapshot_root``. Paths must be on storage shared by the
    cluster (the checkpoint too).
    """
    schema = schemas.TABLES[table]

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        target = _version_path(snapshot_root, batch_id + 1)
        if _committed(spark, target):
            return  # replay of a batch whose snapshot is already written
        base_path = latest_version(spark, snapshot_root, batch_id + 1) or initial_snapshot
        base = read_snapshot(spark, base_path, schema)
        changes.soft_delete(base, batch.select("id")).write.mode("overwrite").parquet(target)

    stream = spark.readStream.schema(schemas.IDS).parquet(changes_dir)
    writer = stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="30 seconds")
    return writer.start()
