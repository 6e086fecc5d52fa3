"""Catalogue tables stored as Parquet snapshots (one directory per table).

Layout under a root: ``users/``, ``products/``, ``product_variations/`` and,
when a batch job needs them, change sets such as ``product_deletes/`` or
``variation_changes/``. Every table is read with its fixed schema.

A root's marker, written last, names the folder of each table that lies elsewhere: a new
version stores the tables that changed and refers to the others where they are, so a batch never copies
what it does not touch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitrine.sources import schemas
from vitrine.sources.tables import path_exists, read_snapshot, write_snapshot

CHANGE_SETS: dict[str, T.StructType] = {
    "product_intake": schemas.PRODUCT_INTAKE,
    "product_deletes": schemas.DELETES,
    "variation_deletes": schemas.DELETES,
    "user_deletes": schemas.IDS,
    "product_updates": schemas.PRODUCT_UPDATES,
    "variation_changes": schemas.VARIATION_CHANGES,
    "variation_forms": schemas.VARIATION_CHANGES,
    "user_changes": schemas.USER_CHANGES,
    "access_requests": T.StructType([T.StructField("event_id", T.LongType()),
                                     T.StructField("user_id", T.LongType()),
                                     T.StructField("product_id", T.LongType())]),
    "email_candidates": T.StructType([T.StructField("id", T.LongType()), T.StructField("email", T.StringType())]),
    "image_assets": T.StructType([T.StructField("image_key", T.StringType()), T.StructField("length", T.LongType()),
                                  T.StructField("mime", T.StringType())]),
}
ALL_TABLES: dict[str, T.StructType] = {**schemas.TABLES, **CHANGE_SETS}


MARKER = "_CATALOGUE"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path of a folder or file, and its file system."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, root: str, elsewhere: dict[str, str] | None = None) -> None:
    """Mark a root as complete; called after its last table is written. ``elsewhere``: folders of tables kept in other roots."""
    path, fs = file_system(spark, f"{root.rstrip('/')}/{MARKER}")
    out = fs.create(path, True)
    out.write(json.dumps({"tables": elsewhere or {}}, sort_keys=True).encode())
    out.close()


def is_snapshot_root(spark: SparkSession, root: str) -> bool:
    """True for a complete root; a root whose tables are still being written is none."""
    return path_exists(spark, f"{root.rstrip('/')}/{MARKER}")


def read_marker(spark: SparkSession, path: str) -> dict:
    """The JSON of a marker; an empty marker says nothing."""
    path, fs = file_system(spark, path)
    if not fs.getFileStatus(path).getLen():
        return {}
    stream = fs.open(path)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def tables_elsewhere(spark: SparkSession, root: str) -> dict[str, str]:
    """Folders of the tables that a root refers to; a root with an empty marker has all its own."""
    return read_marker(spark, f"{root.rstrip('/')}/{MARKER}").get("tables", {})


class SnapshotCatalogue:
    """Same attributes as ``fixtures.Catalogue``, read from stored snapshots."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.elsewhere = tables_elsewhere(spark, self.root)

    def folder(self, name: str) -> str:
        return self.elsewhere.get(name, f"{self.root}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in ALL_TABLES:
            return read_snapshot(self.spark, self.folder(name), ALL_TABLES[name])
        raise AttributeError(name)


def next_version(catalogue, root: str, changed: dict[str, DataFrame], notes: dict[str, DataFrame] | None = None) -> None:
    """Write the changed tables (and ``notes``, tables beside the catalogue such as rejected rows) under a new root
    and publish it as a version of the whole catalogue.

    Tables that did not change are referred to where they are stored. A catalogue that is not stored (derived
    views) has its tables written once, with the first version.
    """
    root = root.rstrip("/")
    for name, df in (notes or {}).items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
    elsewhere = {}
    for name in ALL_TABLES:
        if name in changed:
            write_snapshot(changed[name].select(*[f.name for f in ALL_TABLES[name].fields]), f"{root}/{name}")
        elif isinstance(catalogue, SnapshotCatalogue):
            if path_exists(catalogue.spark, catalogue.folder(name)):
                elsewhere[name] = catalogue.folder(name)
        elif name in schemas.TABLES:
            write_snapshot(getattr(catalogue, name).select(*[f.name for f in ALL_TABLES[name].fields]), f"{root}/{name}")
    publish(catalogue.spark, root, elsewhere)


def export(catalogue, root: str, names: list[str] | None = None) -> list[str]:
    """Write tables of any catalogue (e.g. the fixture views) as snapshots under ``root``."""
    written = []
    for name in names or list(ALL_TABLES):
        df = getattr(catalogue, name)
        write_snapshot(df.select(*[f.name for f in ALL_TABLES[name].fields]), f"{root.rstrip('/')}/{name}")
        written.append(name)
    publish(catalogue.spark, root)
    return written
