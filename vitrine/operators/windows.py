"""Order-dependent values inside groups without sending a whole group to one task.

``row_number().over(partitionBy(key).orderBy(id))`` puts every row of a key in
one task; a supplier or product holding a third of the catalogue would make
that task a third of the job. Here the rows are range partitioned by (key, id),
so a hot key covers many partitions (slices) of about equal size, and their
number follows the table: Spark's sampled bounds cut the rows, and AQE merges
slices that are small. The slice is kept with each row in a checkpoint, so
everything below sees the same cut.

1. a window inside (key, slice) gives the value as far as the slice knows it;
2. one small aggregate row per (key, slice) is carried over the slices of a key;
3. only keys that cover several slices need a correction, so at most one row per
   slice comes back to the rows (a broadcast of that bounded size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import materialise

_SLICE = "__slice"


def _safe_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys as (non-NULL value, is-NULL flag) pairs: NULL is a group of its own, joined by plain equality."""
    types = dict(df.dtypes)
    columns = {}
    for i, k in enumerate(keys):
        columns[f"__k{i}"] = F.coalesce(F.col(k), F.lit("").cast(types[k]) if types[k] == "string" else F.lit(0).cast(types[k]))
        columns[f"__n{i}"] = F.col(k).isNull()
    return df.withColumns(columns) if columns else df, list(columns)


def in_slices(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The rows with their slice of the (keys, order) range."""
    return materialise(df.repartitionByRange(*keys, order).withColumn(_SLICE, F.spark_partition_id()))


def _corrected(rows: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    """``carried`` (keys, slice, values) joined to the rows of its slices; it has at most one row per slice."""
    of = {**{k: f"__of{k}" for k in keys}, _SLICE: "__bucket"}
    renamed = carried.select(*[F.col(c).alias(of.get(c, c)) for c in carried.columns])
    on = [F.col(c) == F.col(other) for c, other in of.items()]
    return rows.join(F.broadcast(renamed), on, "left").drop(*of.values())


def row_number_by_id(df: DataFrame, keys: list[str], id_col: str = "id", descending: bool = False,
                     out_col: str = "rn") -> DataFrame:
    """Add ``out_col`` = position of the row inside its ``keys`` group, ordered by ``id_col``.

    ``id_col`` is unique inside a group. The result is exactly ``row_number``, as a bigint.
    """
    order = F.col(id_col).desc() if descending else F.col(id_col).asc()
    d, safe = _safe_keys(df, keys)
    d = in_slices(d, safe, order)
    local = d.withColumn("__local", F.row_number().over(Window.partitionBy(*safe, _SLICE).orderBy(order)))
    counts = d.groupBy(*safe, _SLICE).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*safe).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*safe, _SLICE, F.sum("__n").over(before).alias("__offset")).filter("__offset is not null")
    return (_corrected(local, safe, offsets)
            .withColumn(out_col, (F.col("__local") + F.coalesce("__offset", F.lit(0))).cast("bigint"))
            .drop("__local", "__offset", _SLICE, *safe))


def last_before(df: DataFrame, keys: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """Add columns: for each ``out: value``, the last non-NULL ``value`` of the same group in a row before this one, by ``order``."""
    d, safe = _safe_keys(df, keys)
    d = in_slices(d, safe, F.col(order))
    before = Window.partitionBy(*safe, _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumns({f"__local_{out}": F.last(v, ignorenulls=True).over(before) for out, v in values.items()})
    ends = d.groupBy(*safe, _SLICE).agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"__end_{out}") for out, v in values.items()])
    earlier = Window.partitionBy(*safe).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = [f"__carried_{out}" for out in values]
    ends = ends.select(*safe, _SLICE, *[F.last(f"__end_{out}", ignorenulls=True).over(earlier).alias(c)
                                        for out, c in zip(values, carried)])
    # of a key's slices all but the first may need a correction: fewer rows than slices in all
    rows = _corrected(local, safe, ends.filter(" OR ".join(f"{c} IS NOT NULL" for c in carried)))
    return rows.withColumns({out: F.coalesce(f"__local_{out}", c) for out, c in zip(values, carried)}).drop(
        *[f"__local_{out}" for out in values], *carried, _SLICE, *safe)


def sum_before(df: DataFrame, keys: list[str], order: str, value: str, out_col: str) -> DataFrame:
    """Add ``out_col`` = the sum of ``value`` over the rows of the same group that come before this one by ``order``."""
    d, safe = _safe_keys(df, keys)
    d = in_slices(d, safe, F.col(order))
    before = Window.partitionBy(*safe, _SLICE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = d.withColumn("__local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    earlier = Window.partitionBy(*safe).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*safe, _SLICE).agg(F.sum(value).alias("__sum"))
    offsets = sums.select(*safe, _SLICE, F.sum("__sum").over(earlier).alias("__offset")).filter("__offset is not null")
    return (_corrected(local, safe, offsets)
            .withColumn(out_col, (F.col("__local") + F.coalesce("__offset", F.lit(0))).cast("bigint"))
            .drop("__local", "__offset", _SLICE, *safe))


def page_numbers(df: DataFrame, keys: list[str], page_size: int, id_col: str = "id",
                 descending: bool = True) -> DataFrame:
    """WIN-1: row number and 0-based page of every row inside its group (newest first)."""
    numbered = row_number_by_id(df, keys, id_col, descending, "rn")
    return numbered.withColumn("page", F.floor((F.col("rn") - 1) / F.lit(page_size)).cast("bigint"))
