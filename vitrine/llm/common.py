"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ensure_checkpoint_dir

#: A word is a run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Send a module's functions with the task, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` in the tasks, from a broadcast. Spark pickles what it broadcasts by the name of its
    class, which executors without the package cannot look up; here the class goes along."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: read by several later steps, safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, read back.

    For loops and many-step jobs: unlike a checkpoint, the table carries no
    constraints of the plan behind it, which multiply with every round of aliases and
    fill the driver, and it has sizes of its own for the joins that read it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getName().startswith("stored-"):
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which a side is known to be small enough for every executor.
SMALL_ROWS = 10_000


def small_side(df: DataFrame) -> DataFrame:
    """A join side, broadcast when it is counted to be small; it is read from a checkpoint, whose size Spark
    does not know, and would else make the other side shuffle its texts."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have a null fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def text_blocks(texts: Iterable[str | None], max_chars: int = 250_000) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``max_chars`` characters; null is the empty text."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= max_chars:
            yield block
            block, size = [], 0
    if block:
        yield block
