"""Table access: raw driver tables, catalogue snapshots, and a JDBC reader.

Everything is read with an explicit schema or an explicit column list, so the
Parquet scan only reads the columns a job uses (``ReadSchema`` in the plan) and
filters reach the scan as ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T



def raw(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One of the driver's Parquet tables, pruned to ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A catalogue table written by a previous job (Parquet, fixed schema)."""
    return spark.read.schema(schema).parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new snapshot directory; never overwrites an existing one."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: T.StructType,
              num_partitions: int, lower_id: int, upper_id: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """Read a live table in parallel, split on its integer primary key ``id``.

    Only the columns of ``schema`` are selected, so the password column of the
    user table never leaves the database.
    """
    reader = (spark.read.format("jdbc")
              .option("url", url)
              .option("dbtable", table)
              .option("partitionColumn", "id")
              .option("lowerBound", str(lower_id))
              .option("upperBound", str(upper_id))
              .option("numPartitions", str(num_partitions)))
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    df = reader.load()
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
