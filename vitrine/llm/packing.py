"""Best-fit packing of documents into sequences of at most ``SIZE`` tokens.

A document's ids get an end id. Only longer documents are cut, into full pieces
after a first one that takes the remainder, so every document has at most one
piece that is not full. Pieces are packed online: at most ``OPEN_BINS`` open bins, kept
in a bitset by free space. A piece goes to the open bin with the least room that
still fits; without one a new bin opens, and when too many are open the fullest
closes. A full piece is a sequence of its own. Pieces come in runs of ``RUN``, each run longest
first, so that its short pieces fill what its long ones leave.

The piece table (ids, lengths and checksums, no text) is checkpointed and dealt by
hash over tasks of about ``PIECES_PER_TASK`` rows, each with its own bins, so the
space lost at the end of a task stays far below one percent whatever the input's
own partitions are. A task holds one run of pieces and its open bins.

Defined cases: null and empty texts are one piece, the end id; repeated rows are
packed each; null ids are kept; an empty table gives no rows; other columns are
ignored. A sequence id is the task's number and a count within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import tokens
from vitrine.llm.common import checkpointed, ship_by_value, shipped

ship_by_value(__name__)

SIZE = 1024
END_ID = 2
OPEN_BINS = 256
RUN = 1024
PIECES_PER_TASK = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    shared = shipped(docs.sparkSession, tokens.read_vocabulary(vocabulary))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(shared())
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in SCHEMA.names}
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts)):
                ids += end
                n = len(ids) // 4
                start, number = 0, 0
                while start < n:
                    length = (n - start) % size or size
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    for column, value in zip(rows.values(), (doc_id, number, start, length, crc)):
                        column.append(value)
                    start, number = start + length, number + 1
            yield pa.RecordBatch.from_pydict(rows, schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit_bins(lengths: Iterator[int], size: int = SIZE, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(bin number, offset) of each piece, in order."""
    by_free: list[list[int]] = [[] for _ in range(size + 1)]
    occupied, n_open, n_bins = 0, 0, 0
    for length in lengths:
        fitting = occupied >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = by_free[free].pop()
            n_open -= 1
            if not by_free[free]:
                occupied ^= 1 << free
        else:
            free, number, n_bins = size, n_bins, n_bins + 1
        yield number, size - free
        left = free - length
        if left:
            by_free[left].append(number)
            occupied |= 1 << left
            n_open += 1
            if n_open > open_bins:
                fullest = (occupied & -occupied).bit_length() - 1
                by_free[fullest].pop()
                n_open -= 1
                if not by_free[fullest]:
                    occupied ^= 1 << fullest


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, size: int = SIZE, end_id: int = END_ID,
         open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = checkpointed(pieces(docs, vocabulary, size, end_id))
    tasks = max(1, -(-table.count() // per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = table.withColumn("__order", order).repartition(tasks, "__order").sortWithinPartitions(
        "__order", "doc_id", F.desc("length"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        waiting: list[list[int]] = []  # the lengths of the batch in hand feed the bins, which live as long as the task

        def lengths() -> Iterator[int]:
            while True:
                yield from waiting.pop()

        bins = best_fit_bins(lengths(), size, open_bins)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                run = batch.slice(at, RUN)
                run = run.take(pa.array(np.argsort(-run.column("length").to_numpy(), kind="stable")))
                waiting.append(run.column("length").to_pylist())
                places = [next(bins) for _ in range(run.num_rows)]
                yield (run.append_column("sequence_id", pa.array([base + b for b, _ in places], pa.int64()))
                       .append_column("offset", pa.array([o for _, o in places], pa.int64())))

    return dealt.drop("__order").mapInArrow(place, PIECES + ", sequence_id long, offset long")
