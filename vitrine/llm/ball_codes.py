"""Vectors as short codes: four parts, each the nearest entry of its codebook, trained by ball k-means.

Components are integers (the floor of SCALE times the component), so every distance, sum
and mean is exact and the result does not depend on how the rows are dealt.

A round is one pass. A task holds, per part and entry, the ball of the entry: its members
in order of their distance d from it. Entry j can be as near to a member as its own entry i
only if dist(i, j) <= 2 d. So with the other entries in order of their distance from i:

* the radius (the farthest member's d) bounds the ball's neighbour entries: those within 2 radii;
* members with 2 d < the distance of the nearest neighbour are the stable core and keep their entry;
* the others lie in rings: in the k-th ring only the k nearest neighbours are compared.

All comparisons use squared integers (dist^2 <= 4 d^2), so ties are seen and go to the lower
index. The first pass has no balls yet and compares all entries. Rows with their codes are a
table after each round, so a lost executor costs one pass; sums per entry are added up in
the task, then in a shuffle of at most ENTRIES * dimension rows per task. What the driver and the
tasks hold of the codebooks is ENTRIES * dimension numbers, whatever the number of vectors.

Defined cases: vectors that are null or hold null, NaN or infinite components are dropped, and so are those whose
length is not that of the first kept vector or no positive multiple of four; a null
vec_id comes after all others when the first entries are chosen, equal vec_ids in order of their components;
with fewer than ENTRIES vectors the codebooks are shorter; repeated rows are returned each;
vectors with null labels share one label error; an empty table gives no rows; other columns are ignored.
A component of LARGEST or more after scaling is an error, since its squares would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import discard, ship_by_value, small_side, stored

ship_by_value(__name__)

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 1 << 28
#: Vectors whose balls are built at once, and neighbours that are compared at once.
AT_ONCE, NEIGHBOURS = 65_536, 64


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, values: the rows that take part, with integer components."""
    whole = F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.filter(whole & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).select(
        "vec_id", "label", values.alias("values"))


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where every sum of their squares is a whole number that a double holds, else as they are."""
    size = int(max(np.abs(a).max(initial=0) for a in arrays))
    if 4 * size * size * arrays[0].shape[-1] < 1 << 53:
        return [a.astype(np.float64) for a in arrays]
    return list(arrays)


def squares(x: np.ndarray, entries: np.ndarray, x_norm: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of all rows from all entries, exact for arrays that ``exact`` gave."""
    x_norm = (x * x).sum(axis=1) if x_norm is None else x_norm
    return x_norm[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, by comparing all."""
    code, best = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    x, entries = exact(x, entries)
    for at in range(0, len(x), 8192):
        far = squares(x[at:at + 8192], entries)
        code[at:at + 8192], best[at:at + 8192] = far.argmin(axis=1), far.min(axis=1)
    return code, best


class Balls:
    """A part's entries, each with the others in order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        whole = exact(entries)[0]
        apart = squares(whole, whole).astype(np.int64)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, given its entry so far; and the distances computed."""
        own = ((x - self.entries[code]) ** 2).sum(axis=1)
        rows = np.lexsort((own, code))
        first = np.flatnonzero(np.concatenate([[True], code[rows][1:] != code[rows][:-1]]))
        new_code, new_best, count = code.copy(), own.copy(), len(x)
        x, entries = exact(x, self.entries)
        norm = (x * x).sum(axis=1)
        for members in np.split(rows, first[1:]) if len(rows) else []:
            i = code[members[0]]
            ring = np.searchsorted(self.apart[i], 4 * own[members], side="right")  # 0: the stable core
            for k in range(0, int(ring[-1]), NEIGHBOURS):  # the last member has the radius
                outer = members[np.searchsorted(ring, k, side="right"):]
                others = np.sort(self.order[i][k:min(k + NEIGHBOURS, int(ring[-1]))])  # so that ties go to the lower index
                far = squares(x[outer], entries[others], norm[outer])
                count += far.size
                at = far.argmin(axis=1)
                d, j = far[np.arange(len(outer)), at].astype(np.int64), others[at]
                better = (d < new_best[outer]) | ((d == new_best[outer]) & (j < new_code[outer]))
                new_code[outer[better]], new_best[outer[better]] = j[better], d[better]
        return new_code, new_best, count


#: Rows with their codes, and (with ``entry``) the sums of a task's members of an entry.
STATE_DDL = "vec_id long, label long, values array<long>, codes array<int>, error long, part int, entry int, n long"


def assigned(state: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """The rows with the nearest entry of each part in ``codes`` and their ``error``, and rows of sums per part and entry."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", state.limit(0).toArrow().schema.field("label").type),
                        ("values", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("error", pa.int64()),
                        ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64())])
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b) for b in books]
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)

        def code(table: pa.Table) -> Iterator[pa.RecordBatch]:
            x = table["values"].combine_chunks().flatten().to_numpy().reshape(-1, PARTS, width)
            if len(x) and (np.abs(x) >= LARGEST).any():
                raise ArithmeticError(f"a component is {LARGEST} or more after scaling")
            before = table["codes"].combine_chunks()
            before = before.flatten().to_numpy().reshape(-1, PARTS) if before.null_count == 0 else None
            codes, error = np.empty((len(x), PARTS), dtype=np.int32), np.zeros(len(x), dtype=np.int64)
            for p, ball in enumerate(balls):
                own = x[:, p, :]
                if before is None:
                    codes[:, p], far = nearest(own, ball.entries)
                else:
                    codes[:, p], far, _ = ball.nearest(own, before[:, p].astype(np.int64))
                error += far
                rows = np.argsort(codes[:, p], kind="stable")
                found, first = np.unique(codes[rows, p], return_index=True)
                sums[p, found] += np.add.reduceat(own[rows], first, axis=0)
                counts[p] += np.bincount(codes[:, p], minlength=len(ball.entries))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, PARTS), pa.int32()), pa.array(codes.ravel()))
            empty = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64())]
            out = [table["vec_id"].combine_chunks(), table["label"].combine_chunks(), table["values"].combine_chunks(),
                   lists, pa.array(error), *empty]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema)], schema=schema)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                yield from code(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from code(pa.Table.from_batches(held))
        part, entry = np.nonzero(counts)
        if len(part):
            k = len(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * width + 1, width), pa.int32()),
                                             pa.array(sums[part, entry].ravel()))
            out = [pa.nulls(k, schema.field("vec_id").type), pa.nulls(k, schema.field("label").type), lists,
                   pa.nulls(k, schema.field("codes").type), pa.nulls(k, pa.int64()), pa.array(part.astype(np.int32)),
                   pa.array(entry.astype(np.int32)), pa.array(counts[part, entry])]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    ddl = STATE_DDL.replace("label long", f"label {label_type}")
    return stored(state.select("vec_id", "label", "values", "codes").mapInArrow(run, ddl))


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of its members' mean; entries without members stay."""
    sums = state.filter("entry is not null").select("part", "entry", "n", F.posexplode("values").alias("at", "value"))
    total = sums.groupBy("part", "entry", "at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = books.copy()
    for p, e, at, s, n in total.collect():  # at most ENTRIES * dimension rows
        out[p, e, at] = int(s) // int(n)
    return out


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    kept = kept_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"))
    label_type = kept.schema["label"].dataType.simpleString()
    first = kept.select("vec_id", "values").orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(ENTRIES).collect()
    size = len(first[0]["values"]) if first else PARTS
    books = np.array([r["values"] for r in first if len(r["values"]) == size], dtype=np.int64).reshape(-1, PARTS, size // PARTS)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    state = kept.filter(F.size("values") == size).withColumn("codes", F.lit(None).cast("array<int>"))
    for done in range(rounds + 1):
        before, state = state, assigned(state, books, label_type)
        if done:
            discard(before)
        if done < rounds:
            books = moved(state, books)
            state = state.filter("entry is null")
    state = state.filter("entry is null")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = stored(state.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return state.join(small_side(by_label), F.col("label").eqNullSafe(F.col("own")), "left").select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
