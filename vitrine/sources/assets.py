"""Product image files, listed once and opened for their first bytes only (DQ-20).

The file type is read from the first twelve bytes. Spark's own ``binaryFile`` source reads whole files for that, so
there is a source of its own here: its partitions are runs of the listing, and a task reads the head of each of its files.
The listing is made once, where the query is planned, as Spark's file sources do it. Paths are read through
Arrow's file systems (local folders, object stores, HDFS); for any other store ``read_image_files`` takes Spark's source
and opens files up to the upload limit. The audit is a projection, so it scales with the files and never gathers
them on the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitrine.functions import images

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_BYTES = 12
#: Files whose heads one task reads.
FILES_PER_TASK = 10_000


def _file_system(root: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        system, path = _file_system(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        return [_Files(files[at:at + self.per_task]) for at in range(0, len(files), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, path = _file_system(self.root)
        base = path.rstrip("/") + "/"
        for name, size in partition.files:
            with system.open_input_file(name) as f:
                yield name.removeprefix(base), size, f.read_at(min(HEAD_BYTES, size), 0)


class ImageHeads(DataSource):
    """``image_key`` (path under the root), ``length`` and ``head`` (first bytes) of every file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "image_heads"

    def schema(self) -> str:
        return "image_key string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


def read_image_files(spark: SparkSession, root: str) -> DataFrame:
    """``image_key`` (path under ``root``), ``length`` and detected ``mime`` of every file."""
    try:
        _file_system(root)
    except (ValueError, OSError, NotImplementedError):  # a store that Arrow does not know
        return _read_whole_files(spark, root)
    spark.dataSource.register(ImageHeads)
    files = spark.read.format("image_heads").load(root)
    return files.select("image_key", "length", sniff_mime(F.col("head")).alias("mime"))


def _read_whole_files(spark: SparkSession, root: str) -> DataFrame:
    """The same through Spark's source; files above the upload limit are listed, not opened (``mime`` NULL)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    opened = files.filter(F.col("length") <= images.MAX_BYTES).select(
        "path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    listed = files.filter(F.col("length") > images.MAX_BYTES).select(
        "path", "length", F.lit(None).cast("binary").alias("head"))
    df = opened.unionByName(listed)
    root_uri = root.rstrip("/") + "/"
    key = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root_uri.lstrip("/")), "")
    return df.select(key.alias("image_key"), "length", sniff_mime(F.col("head")).alias("mime"))


def _escape(text: str) -> str:
    import re
    return re.escape(text)


def sniff_mime(head) -> F.Column:
    """MIME type from the file signature: JPEG, PNG, WebP, GIF; NULL otherwise."""
    hexed = F.lower(F.hex(head))
    return (F.when(hexed.startswith("ffd8ff"), F.lit("image/jpeg"))
            .when(hexed.startswith("89504e470d0a1a0a"), F.lit("image/png"))
            .when(hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250"), F.lit("image/webp"))
            .when(hexed.startswith("47494638"), F.lit("image/gif")))


def audit_assets(assets: DataFrame) -> DataFrame:
    """Upload rules: allowed type, at most 5 MiB, allowed extension."""
    mime_ok = F.coalesce(F.col("mime").isin(*images.ALLOWED_MIME), F.lit(False))
    size_ok = F.coalesce(F.col("length") <= images.MAX_BYTES, F.lit(False))
    ext_ok = F.coalesce(images.key_extension(F.col("image_key")).isin(*images.ALLOWED_EXT), F.lit(False))
    return assets.select("image_key", "length", "mime", mime_ok.alias("mime_ok"), size_ok.alias("size_ok"),
                         ext_ok.alias("extension_ok"), (mime_ok & size_ok & ext_ok).alias("valid"))


def audit_image_keys(products: DataFrame) -> DataFrame:
    """DQ-21/22: shape of each product's image key, supplier match, directory escape."""
    img = F.col("image")
    well = images.key_well_formed(img)
    supplier_match = F.coalesce(images.key_supplier(img) == F.col("fournisseur_id"), F.lit(False))
    escapes = images.key_escapes_directory(img)
    status = (F.when(escapes, F.lit("error")).when(~well, F.lit("error"))
              .when(~supplier_match, F.lit("warning")).otherwise(F.lit("ok")))
    return (products.filter(img.isNotNull())
            .select("id", "fournisseur_id", "image", well.alias("well_formed"),
                    supplier_match.alias("supplier_match"), escapes.alias("escapes_directory"),
                    status.alias("status")))
