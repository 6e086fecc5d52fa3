"""Tables stored in partitions, of which a new version rewrites some and refers to the others.

A root holds the partitions written with it (``data/<column>=<value>/``) and a marker, written last, that names the folder of
every partition of the table, also of those in older roots. Nothing is overwritten: readers of an old root see the old
table, and a job that fails leaves a root without a marker, which is none. The marker has one line per partition, so it is
meant for some thousand partitions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.snapshots import file_system, read_marker

MARKER = "_PARTS"


def write(df: DataFrame, root: str, column: str) -> None:
    """A table of its own partitions. Rows are dealt by range of the partition column and hash, so that a partition with a
    third of all rows is written by many tasks."""
    _publish(df.sparkSession, root, _written(df, root, column), df.schema.json())


def _written(df: DataFrame, root: str, column: str) -> dict[str, str]:
    others = [c for c in df.columns if c != column]
    folder = f"{root.rstrip('/')}/data"
    (df.repartitionByRange(column, F.xxhash64(*others)).write.mode("errorifexists").partitionBy(column).parquet(folder))
    path, fs = file_system(df.sparkSession, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {n.split("=", 1)[1]: folder for n in names if "=" in n}


def _publish(spark: SparkSession, root: str, folders: dict[str, str], schema: str) -> None:
    path, fs = file_system(spark, f"{root.rstrip('/')}/{MARKER}")
    out = fs.create(path, True)
    out.write(json.dumps({"parts": folders, "schema": schema}, sort_keys=True).encode())
    out.close()


def read(spark: SparkSession, root: str, column: str, only: DataFrame | None = None) -> DataFrame:
    """The table, or the partitions whose value is among ``only``'s column of that name."""
    from pyspark.sql.types import StructType
    marker = read_marker(spark, f"{root.rstrip('/')}/{MARKER}")
    schema = StructType.fromJson(json.loads(marker["schema"]))
    wanted = None if only is None else _values(only, column)
    by_folder: dict[str, list[str]] = {}
    for value, folder in marker["parts"].items():
        if wanted is None or value in wanted:
            by_folder.setdefault(folder, []).append(f"{folder}/{column}={value}")
    out = spark.createDataFrame([], schema)
    for folder, paths in by_folder.items():  # one per version that still holds partitions
        out = out.unionByName(spark.read.schema(schema).option("basePath", folder).parquet(*paths).select(*schema.names))
    return out


def _values(df: DataFrame, column: str) -> set[str]:
    """The partition values of ``df`` as folders name them; at most one per partition."""
    return {"__HIVE_DEFAULT_PARTITION__" if r[0] is None else str(r[0]) for r in df.select(column).distinct().collect()}


def replace(spark: SparkSession, root: str, df: DataFrame, new_root: str, column: str, touched: DataFrame) -> None:
    """The next version of ``root``: the ``touched`` partitions hold ``df`` (none of it: they are gone), the others stay."""
    marker = read_marker(spark, f"{root.rstrip('/')}/{MARKER}")
    gone = _values(touched, column)
    kept = {v: f for v, f in marker["parts"].items() if v not in gone}
    _publish(spark, new_root, {**kept, **_written(df, new_root, column)}, marker["schema"])
