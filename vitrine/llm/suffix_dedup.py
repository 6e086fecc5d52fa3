"""Removal of passages of WINDOW bytes that occur more than once, by hash-compared suffix sorting.

A window is a string of WINDOW bytes of one text. Every window has an anchor: the first of
its GRAM-byte grams with the least hash. The anchor depends on the window's bytes alone, so
equal windows have equal grams at equal distances from their starts. The windows of a
text thus fall into runs with one anchor each, about one run for 70 bytes; the bytes that
a run's windows cover are its context. Texts are handled once per distinct text (named by md5).

1. One pass over the texts makes the runs. A block of texts asks two questions: is this
   context anywhere else (then all its windows repeat), and has this gram other contexts
   (then some of its windows may)? Questions are distinct per block and packed by
   partition, so a gram or context that a third of all texts hold is one entry per block.
   Answers are one byte per question and go back to the block.
2. Texts with a positive answer, and no others, are read again and kept as a table. Of a
   context that repeats one copy is a witness; it and the contexts that do not repeat, of
   grams with several contexts, go to the gram's partition.
3. There the suffixes from the anchors on are put in order by a mergesort that compares
   through prefix hashes (``suffix_hash``). For every distance from window start to
   anchor, contexts with the same bytes left of the anchor keep that order, so equal
   windows are neighbours in it; what hashes alike is then compared byte by byte.
   A gram with more than HOT contexts is not sorted in one task: its windows ask
   the first question of step 1 one by one (128-bit hashes).
4. The bytes of repeated windows leave each text.

Defined cases: null and empty texts, and texts shorter than WINDOW bytes, lose nothing; copies of
a text of WINDOW bytes or more lose all (also copies with one id, and rows with null ids); matches
may overlap within a text; very long texts are cut into overlapping pieces for step 1 alone;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import shuffle_parts, ship_by_value, small_side, stored
from vitrine.llm.suffix_hash import PrefixHashes, spread, suffix_order

ship_by_value(__name__)

WINDOW = 200
GRAM = 64
#: Grams of a window.
SPAN = WINDOW - GRAM + 1
#: Bytes that are hashed at once, and bytes of texts in a block.
PIECE, BLOCK = 1_000_000, 8_000_000
#: Questions aimed at per partition.
PER_PARTITION = 1_000_000
#: Contexts of one gram that are sorted in one task.
HOT = 1000
#: Hot contexts whose windows make one block.
HOT_BLOCK = 4000
#: Slots of the bitmap that picks texts to read again (a table of SLOTS / 64 rows).
SLOTS = 1 << 22

TEXTS, GRAMS, CONTEXTS = 0, 1, 2
ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()),
                 ("twice", pa.binary()), ("keys", pa.binary()), ("runs", pa.binary()), ("spans", pa.binary())])
ASK_DDL = "part int, block long, kind int, x binary, y binary, twice binary, keys binary, runs binary, spans binary"


def slide(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by the first one."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:len(x) - step], x[step:])
        have += step
    return x


def runs_of(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that begin where ``new`` is true."""
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new)) - 1


def anchored(grams: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (given by ascending starts) with one anchor each: first start, last start, anchor."""
    least = slide(grams, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    top = slide(np.concatenate([edge, least, edge]), SPAN, np.maximum)
    at = np.flatnonzero(top[:len(grams)] == grams)  # positions that are the least of some window
    values, rank = np.unique(grams[at], return_inverse=True)
    width = np.int64(len(grams) + 1)
    order = np.argsort(rank * width + at, kind="stable")
    places, at = (rank * width + at)[order], at[order]

    def anchor_of(start: np.ndarray) -> np.ndarray:
        """The first place at or after the window's start that has the least hash of the window."""
        return at[np.searchsorted(places, np.searchsorted(values, least[start]) * width + start)]

    low = least[windows]
    first, last = runs_of(np.concatenate([[True], (low[1:] != low[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    start, stop = windows[first], windows[last]
    anchor = anchor_of(start)
    again = anchor < stop  # the least gram comes a second time: such windows are looked up one by one
    if again.any():
        length = (stop - start + 1)[again]
        each = np.repeat(start[again] - np.cumsum(length) + length, length) + np.arange(length.sum())
        own = anchor_of(each)
        first, last = runs_of(np.concatenate([[True], (own[1:] != own[:-1]) | (each[1:] != each[:-1] + 1)]))
        start, stop, anchor = (np.concatenate(c) for c in (
            (start[~again], each[first]), (stop[~again], each[last]), (anchor[~again], own[first])))
        order = np.argsort(start)
        start, stop, anchor = start[order], stop[order], anchor[order]
    return start, stop, anchor


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers of texts, and bytes of them, about PIECE at once; longer texts are cut so that no window is lost."""
    numbers, held, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
            numbers.append(number)
            held.append(text[at:at + PIECE + WINDOW - 1])
            size += len(held[-1])
            if size >= PIECE:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def block_runs(hashes: PrefixHashes, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of a block's texts, in order: text number, windows, distance of the anchor, gram hash, context hash (two)."""
    out = []
    for numbers, held in pieces(texts):
        joined = b"".join(held)
        data = np.frombuffer(joined, dtype=np.uint8)
        size = np.array([len(h) for h in held])
        end = np.cumsum(size)
        windows = np.concatenate([np.arange(e - s, e - WINDOW + 1) for s, e in zip(size, end)])
        grams = hashes.read(data).grams(GRAM)
        start, stop, anchor = anchored(grams, windows)
        context = b"".join([xxhash.xxh3_128_digest(joined[s:e]) for s, e in zip(start.tolist(), (stop + WINDOW).tolist())])
        context = np.frombuffer(context, dtype=">u8").astype(np.uint64).reshape(-1, 2)
        number = np.array(numbers)[np.searchsorted(end, start, side="right")]
        out.append((number, stop - start + 1, anchor - start, grams[anchor], context[:, 0], context[:, 1]))
    return tuple(np.concatenate(c) for c in zip(*out))


def questions(kind: int, block: int, parts: int, x: np.ndarray, y: np.ndarray, twice: np.ndarray) -> Iterator[dict]:
    """Rows of distinct questions (x ascending), packed by partition of x."""
    part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(cut[:-1] < cut[1:]):
        of = slice(cut[p], cut[p + 1])
        yield {"part": int(p), "block": block, "kind": kind, "x": x[of].tobytes(), "y": y[of].tobytes(),
               "twice": twice[of].astype(np.uint8).tobytes()}


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, how often each occurs, and for every element the index of its pair."""
    order = np.lexsort((y, x))
    a, b = x[order], y[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    index = np.empty(len(x), dtype=np.int64)
    index[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(index), index


def block_rows(block: int, parts: int, keys: list[bytes], runs: tuple[np.ndarray, ...]) -> Iterator[dict]:
    """The questions of a block of texts, and the row that holds what the answers are for."""
    number, windows, distance, gram, high, low = runs
    a, b, count, context_at = distinct(high, low)
    yield from questions(CONTEXTS, block, parts, a, b, count > 1)
    g, c, _, pair_at = distinct(gram, high)
    first, last = runs_of(np.concatenate([[True], g[1:] != g[:-1]]))
    gram_at = (np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1)[pair_at]
    yield from questions(GRAMS, block, parts, g[first], c[first], last > first)
    each = np.bincount(number, minlength=len(keys)).astype(np.uint32)
    spans = np.stack([windows, distance], axis=1).astype(np.uint8)
    yield {"part": block % parts, "block": block, "kind": TEXTS, "x": gram_at.astype(np.uint32).tobytes(),
           "y": context_at.astype(np.uint32).tobytes(), "keys": b"".join(keys), "runs": each.tobytes(),
           "spans": spans.tobytes()}


def new_block(count: int) -> int:
    """A number for a task's next block; the rows are kept in a table, so a rerun of the task does no harm."""
    return (TaskContext.get().partitionId() << 24) + count


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """block, kind, part, answer for each row of questions, and the other rows as they are.

    An answer is a byte per question: 1 if another block, or this one twice, has it (CONTEXTS: the same pair; GRAMS:
    another y with this x), plus 2 if this is the first block that has it.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {GRAMS: [], CONTEXTS: []}
        for batch in batches:
            rows = batch.to_pylist()
            yield from batches_of((r for r in rows if r["kind"] == TEXTS), ASK)
            for r in rows:
                if r["kind"] != TEXTS:
                    held[r["kind"]].append((r["part"], r["block"], *(
                        np.frombuffer(r[c], t) for c, t in (("x", np.uint64), ("y", np.uint64), ("twice", np.uint8)))))
        for kind, rows in held.items():
            if not rows:
                continue
            part, block, x, y, twice = zip(*rows)
            size = np.array([len(a) for a in x])
            of = np.repeat(np.array(block), size)
            x, y, twice = np.concatenate(x), np.concatenate(y), np.concatenate(twice)
            order = np.lexsort((of, y, x)) if kind == CONTEXTS else np.lexsort((of, x))
            a, b = x[order], y[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if kind == CONTEXTS else False)])
            first, last = runs_of(new)
            if kind == CONTEXTS:
                several = last > first
            else:
                several = np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)
            several |= np.maximum.reduceat(twice[order], first) > 0
            out = np.empty(len(x), dtype=np.uint8)
            out[order] = np.repeat(several, last - first + 1).astype(np.uint8) + 2 * new.astype(np.uint8)
            cut = np.cumsum(size)
            yield from batches_of(({"part": p, "block": k, "kind": kind, "x": out[c - n:c].tobytes()}
                                   for p, k, n, c in zip(part, block, size, cut)), ASK)

    return stored(asked.repartitionById(parts, "part").mapInArrow(answer, ASK_DDL))


def answered(texts: pa.Table, replies: pa.Table) -> Iterator[tuple[dict, dict[int, np.ndarray]]]:
    """A block's row with the answers to its questions, by kind."""
    found = {}
    for kind in (GRAMS, CONTEXTS):
        rows = sorted((p, x) for k, p, x in zip(*(replies[c].to_pylist() for c in ("kind", "part", "x"))) if k == kind)
        found[kind] = np.frombuffer(b"".join(x for _, x in rows), dtype=np.uint8)
    for row in texts.to_pylist():
        yield row, found


VERDICT = pa.schema([("key", pa.binary()), ("block", pa.int64()), ("spans", pa.binary()), ("verdict", pa.binary())])


def verdicts(texts: pa.Table, replies: pa.Table) -> pa.Table:
    """key, spans and verdict of a block's texts that have one: per run 1 (its windows repeat) plus 2 (its context
    goes to the gram's partition)."""
    out = []
    for row, found in answered(texts, replies):
        at = np.frombuffer(row["y"], np.uint32)
        repeats = (found[CONTEXTS][at] & 1) == 1
        first = np.zeros(len(at), dtype=bool)
        first[np.unique(at, return_index=True)[1]] = True
        contested = (found[GRAMS][np.frombuffer(row["x"], np.uint32)] & 1) == 1
        ship = contested & (~repeats | (first & (found[CONTEXTS][at] >= 2)))
        verdict = repeats + 2 * ship.astype(np.uint8)
        spans = np.frombuffer(row["spans"], np.uint8).reshape(-1, 2)
        end = np.cumsum(np.frombuffer(row["runs"], np.uint32).astype(np.int64))
        begin = np.concatenate([[0], end[:-1]])
        some = np.add.reduceat(np.append(verdict, 0), np.minimum(begin, len(verdict))) if len(end) else end
        for k in np.flatnonzero((some > 0) & (end > begin)):
            of = slice(begin[k], end[k])
            out.append({"key": row["keys"][16 * k:16 * k + 16], "block": row["block"],
                        "spans": spans[of].tobytes(), "verdict": verdict[of].tobytes()})
    return pa.Table.from_pylist(out, schema=VERDICT)


def run_starts(spans: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and distance of the anchor of a text's runs."""
    windows, distance = np.frombuffer(spans, np.uint8).reshape(-1, 2).astype(np.int64).T
    return np.cumsum(windows) - windows, windows, distance


CONTEXT = pa.schema([("gram", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("windows", pa.int32()),
                     ("distance", pa.int32()), ("witness", pa.bool_()), ("context", pa.binary())])
CONTEXT_DDL = "gram long, key binary, start int, windows int, distance int, witness boolean, context binary"


def shipped_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                verdict = np.frombuffer(r["verdict"], np.uint8)
                for k, s, n, d in zip(np.flatnonzero(verdict >= 2), *(c[verdict >= 2].tolist() for c in run_starts(r["spans"]))):
                    data = r["data"][s:s + n - 1 + WINDOW]
                    gram = xxhash.xxh3_64_intdigest(data[d:d + GRAM]) - (1 << 63)
                    yield {"gram": gram, "key": r["key"], "start": s, "windows": n, "distance": d,
                           "witness": bool(verdict[k] & 1), "context": data}

    yield from batches_of(rows(), CONTEXT, 1000)


HIT = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])
HIT_DDL = "key binary, first int, last int"


def hit_rows(key: list[bytes], start: np.ndarray, windows: np.ndarray, witness: np.ndarray, hit: np.ndarray) -> Iterator[dict]:
    """Runs of repeated windows; ``hit`` has a flag per window, context by context."""
    context = np.repeat(np.arange(len(start)), windows)
    window = np.arange(len(hit)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(start, windows)
    at = np.flatnonzero(hit & ~np.repeat(witness, windows))
    if len(at):
        context, window = context[at], window[at]
        first, last = runs_of(np.concatenate([[True], (context[1:] != context[:-1]) | (window[1:] != window[:-1] + 1)]))
        for k, a, b in zip(context[first].tolist(), window[first].tolist(), window[last].tolist()):
            yield {"key": key[k], "first": a, "last": b}


def repeated_windows(hashes: PrefixHashes, gram: np.ndarray, context: list[bytes], windows: np.ndarray,
                     distance: np.ndarray) -> np.ndarray:
    """A flag per window, context by context: an equal window of the same gram is in another of the contexts."""
    size = np.array([len(c) for c in context])
    begin = np.cumsum(size) - size
    hashes.read(np.frombuffer(b"".join(context), dtype=np.uint8))
    anchor = begin + distance
    order = suffix_order(hashes, anchor, begin + size, WINDOW, gram)
    base = np.cumsum(windows) - windows
    hit = np.zeros(int(windows.sum()), dtype=bool)
    for left in range(SPAN):  # bytes between the window's start and the anchor
        of = order[(left <= distance[order]) & (left > distance[order] - windows[order])]
        at = anchor[of] - left
        same = spread((hashes.sums[anchor[of] + GRAM] - hashes.sums[at]) * hashes.down[at])
        kept = np.argsort(same, kind="stable")  # suffixes with the same bytes on the left, still in order
        of, at, same = of[kept], at[kept], same[kept]
        near = np.flatnonzero((same[1:] == same[:-1]) & hashes.equal(at[1:], at[:-1], WINDOW))
        near = near[hashes.same_bytes(at[near], at[near + 1], WINDOW)]
        for end in (near, near + 1):
            hit[base[of[end]] + distance[of[end]] - left] = True
    return hit


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    gram, start, windows, distance = (table[c].to_numpy().astype(np.int64) for c in ("gram", "start", "windows", "distance"))
    hit = repeated_windows(PrefixHashes(), gram, table["context"].to_pylist(), windows, distance)
    yield from batches_of(hit_rows(table["key"].to_pylist(), start, windows, table["witness"].to_numpy(), hit), HIT, 10_000)


def hot_hits(contexts: DataFrame, parts: int) -> DataFrame:
    """Repeated windows of contexts whose gram has very many: every distinct window of a block is a question."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            held: list[dict] = []
            blocks = 0

            def flush() -> Iterator[dict]:
                nonlocal blocks
                digests = b"".join(xxhash.xxh3_128_digest(r["context"][k:k + WINDOW]) for r in held for k in range(r["windows"]))
                high, low = np.frombuffer(digests, dtype=">u8").astype(np.uint64).reshape(-1, 2).T
                a, b, count, index = distinct(high, low)
                yield from questions(CONTEXTS, new_block(blocks), parts, a, b, count > 1)
                spans = np.array([(r["start"], r["windows"], r["witness"]) for r in held], dtype=np.int64)
                yield {"part": new_block(blocks) % parts, "block": new_block(blocks), "kind": TEXTS,
                       "y": index.astype(np.uint32).tobytes(), "keys": b"".join(r["key"] for r in held), "spans": spans.tobytes()}
                blocks += 1

            for batch in batches:
                for r in batch.to_pylist():
                    held.append(r)
                    if len(held) == HOT_BLOCK:
                        yield from flush()
                        held.clear()
            if held:
                yield from flush()

        yield from batches_of(rows(), ASK)

    def hits(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row, found in answered(texts, replies):
            start, windows, witness = np.frombuffer(row["spans"], np.int64).reshape(-1, 3).T
            hit = (found[CONTEXTS][np.frombuffer(row["y"], np.uint32)] & 1) == 1
            keys = [row["keys"][k:k + 16] for k in range(0, len(row["keys"]), 16)]
            out += hit_rows(keys, start, windows, witness == 1, hit)
        return pa.Table.from_pylist(out, schema=HIT)

    replies = answers(contexts.mapInArrow(ask, ASK_DDL), parts)
    return by_block(replies, hits, HIT_DDL)


def by_block(replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    texts = replies.filter(F.col("kind") == TEXTS).groupBy("block")
    return texts.cogroup(replies.filter(F.col("kind") != TEXTS).select("block", "kind", "part", "x").groupBy("block")).applyInArrow(fn, ddl)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, data (the bytes of the text) and key (its md5)."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select("doc_id", data.alias("data")).withColumn("key", F.unhex(F.md5("data")))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def _picked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys``, and a few others by chance: a bitmap in a table of at most SLOTS / 64 rows."""
    bits = stored(keys.select(_slot(F.col("key")).alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")))
    slotted = rows.withColumn("slot", _slot(F.col("key"))).withColumn("word", F.floor(F.col("slot") / 64))
    return slotted.join(F.broadcast(bits), "word").filter("(shiftright(bits, CAST(slot % 64 AS INT)) & 1L) = 1L").select(*rows.columns)


RESULT_DDL = "key binary, n_removed long, n_spans long, kept_sha256 string"
RESULT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their repeated windows."""
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8)
                start, windows, _ = run_starts(r["spans"])
                repeats = (np.frombuffer(r["verdict"], np.uint8) & 1) == 1
                hits = r["hits"] or []
                first = np.concatenate([start[repeats], np.array([h["first"] for h in hits], dtype=np.int64)])
                last = np.concatenate([(start + windows - 1)[repeats], np.array([h["last"] for h in hits], dtype=np.int64)])
                edges = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edges, first, 1)
                np.add.at(edges, last + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                yield {"key": r["key"], "n_removed": int(gone.sum()), "n_spans": spans,
                       "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()}

    yield from batches_of(rows(), RESULT, 1000)


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay."""
    spark = docs.sparkSession
    named = _named(docs)
    long = named.filter(F.octet_length("data") >= WINDOW)
    n_bytes = long.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    parts = int(max(shuffle_parts(spark), -(-2 * n_bytes // (70 * PER_PARTITION))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            hashes = PrefixHashes()
            held: dict[bytes, bytes] = {}
            size = blocks = 0
            for batch in batches:
                for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
                    size += len(data) if key not in held else 0
                    held[key] = data
                    if size >= BLOCK:
                        yield from block_rows(new_block(blocks), parts, list(held), block_runs(hashes, list(held.values())))
                        held, size, blocks = {}, 0, blocks + 1
            if held:
                yield from block_rows(new_block(blocks), parts, list(held), block_runs(hashes, list(held.values())))

        yield from batches_of(rows(), ASK)

    replies = answers(long.select("key", "data").mapInArrow(ask, ASK_DDL), parts)
    found = by_block(replies, verdicts, "key binary, block long, spans binary, verdict binary")
    # of the blocks that hold a text, the first one has its witnesses
    found = stored(found.groupBy("key").agg(F.min_by(F.struct("spans", "verdict"), "block").alias("run")).select("key", "run.*"))
    texts = _picked(long.select("key", "data"), found).groupBy("key").agg(F.first("data").alias("data"))
    texts = stored(texts.join(found, "key"))
    contexts = stored(texts.mapInArrow(shipped_contexts, CONTEXT_DDL))
    hot = stored(contexts.groupBy("gram").count().filter(F.col("count") > HOT).select("gram"))
    near = contexts.join(small_side(hot), "gram", "left_anti").withColumn("part", F.pmod("gram", F.lit(parts)).cast("int"))
    hits = near.repartitionById(parts, "part").mapInArrow(resolve, HIT_DDL)
    if not hot.isEmpty():
        hits = hits.unionByName(hot_hits(contexts.join(small_side(hot), "gram", "left_semi"), parts))
    hits = stored(hits).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("hits"))

    copies = stored(long.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("data").cast("long")).alias("n_removed"))
                    .filter("n > 1").select("key", "n_removed", F.lit(1).cast("long").alias("n_spans"),
                                            F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256")))
    single = texts.join(copies.select("key"), "key", "left_anti")
    # a run that repeats somewhere else as a whole needs no window of its own; others wait for theirs
    waits = F.locate("\u0002", F.decode("verdict", "ISO-8859-1")) > 0
    results = single.filter(waits).join(hits, "key", "left").unionByName(
        single.filter(~waits).withColumn("hits", F.lit(None).cast("array<struct<first:int,last:int>>")))
    results = stored(results.mapInArrow(cleaned, RESULT_DDL).unionByName(copies))
    own = named.select("doc_id", "key", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    return own.join(results, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
