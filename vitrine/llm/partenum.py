"""N-gram Jaccard join by PartEnum signatures, and the groups its links make.

A document's set holds its distinct 5-word shingles, as 64-bit hashes. Documents with
equal sets are one class, named by a 64-bit fingerprint of the set; everything below
works on classes, so exact copies never meet.

Signatures. Sets are banded by size, [2^i, 2^(i+1)). The shingle domain is cut into
``groups x parts`` partitions by hash; for each group every subset of ``chosen`` of its
parts is enumerated, and a signature is the subset with the set's content there. Two
sets with Jaccard >= 0.75 differ in h <= (|A| + |B|) / 7 shingles, and each differing
shingle spoils at most C(parts - 1, chosen - 1) signatures. So of the signatures of
either set, put in one order that depends on the signatures alone (most shingles
first, then hash), the first common one is among the first
``spoilt = h * C(parts - 1, chosen - 1)`` plus one. A set emits just those, for its
own band and, if its partner may be larger than that band, for the next. The order
puts selective signatures first. A set with too few non-empty signatures for this
argument also emits one signature shared by all such sets of the instance. So no
pair is missed.

Join. Each task keeps, for a signature it sees in several classes, the least class
and a pair (least class, other) for each of the others; only the least goes on to
the signature's partition, where the same is done again. A signature held by a third
of all classes thus sends one row per task, and pairs are as many as the members,
not their square. What this leaves:

1. Pairs with the least partner of each class are compared, then the pairs whose
   ends are not yet in one component. Compared means: two exact filters come first
   (sizes; counts of shingles per hash cell, whose differences never exceed the sets'
   difference), then texts are read again, and the overlap of the sets decides.
2. If every pair under a least class joined its ends, all classes under it are in one
   component and nothing more can come from its signatures. Else the classes
   under it that lie in different components are compared with each other, by the
   same filters and overlap. Such a neighbourhood is cut into blocks, and each pair
   of blocks is a group of its own, so no task holds a whole hot one. A group gives
   not its close pairs but a spanning forest of them, fewer rows than it has classes.
   Where all edges of the forest are links, nothing more can come of the group. Else
   its classes name partners in other components that were not tried yet, in each round
   WIDER times as many as in the round before. A group in which no class had more
   partners than it could name is done.

Defined cases: null texts and texts without a word have empty sets, no links and
their own id as component; texts of fewer than five words have their whole sequence
as one shingle; repeated rows are one class, and each row is returned; a null id is
never a component while another id is in it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from vitrine.llm.common import ship_by_value, shuffle_parts, stored, text_blocks
from vitrine.llm.components import components

ship_by_value(__name__)

SHINGLE = 5
PERCENT = 75
#: Least and most cells of the shingle counts that filter pairs: about one cell per shingle, so that few
#: differences cancel out. Whole neighbourhoods are first compared with COARSE times fewer cells.
CELLS = (64, 8192)
COARSE = 8
#: Signatures a task holds before it passes them on, and those aimed at per partition.
FLUSH = 500_000
PER_PARTITION = 1_000_000
#: Classes of a neighbourhood, and bytes of their cells, that make a block; two blocks are compared in one group.
BLOCK, BLOCK_BYTES = 8192, 8_000_000
#: Growth of the number of partners that a class names from round to round.
WIDER = 1024
#: Slots of the bitmap that picks texts to read again (a table of SLOTS / 64 rows).
SLOTS = 1 << 22
MEMO = 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for block in text_blocks(texts):
            words = [t.encode("utf-8", "surrogatepass").lower().split() for t in block]  # A-Z; space and 09-0D
            if len(self.known) > MEMO:
                self.known.clear()
                self.hashes = self.hashes[:0]
            new = list(set().union(*words) - self.known.keys())
            if new:
                self.known.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new))))
                more = np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64)
                self.hashes = np.concatenate([self.hashes, more])
            for w in words:
                yield shingles(self.hashes[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))])


def shingles(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    width = min(n, SHINGLE)
    rolled = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = (rolled + words[k:n - width + 1 + k]) * _A
        rolled ^= rolled >> np.uint64(29)
    return np.unique(mix(rolled))


def fingerprint(members: np.ndarray) -> int:
    """The class of a set, as an even signed long; the lowest bit is free for a mark."""
    return int((mix(members + _A).sum(dtype=np.uint64) ^ np.uint64(len(members))).view(np.int64)) & ~1


def cells(members: np.ndarray) -> bytes:
    """Shingles per cell of the hash range, at most 255; larger sets have more cells, always a power of two."""
    bits = min(max((len(members) - 1).bit_length(), CELLS[0].bit_length() - 1), CELLS[1].bit_length() - 1)
    counts = np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(counts: bytes, width: int) -> np.ndarray:
    """The counts in ``width`` cells, neighbouring cells added up."""
    return np.frombuffer(counts, np.uint8).reshape(width, -1).sum(axis=1, dtype=np.int32)


def may_link(n: int, counts: bytes, m: int, other: bytes) -> bool:
    """False only if sets of n and m shingles with these counts cannot link."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    width = min(len(counts), len(other))
    return 7 * int(np.abs(folded(counts, width) - folded(other, width)).sum()) <= n + m


def coarse_cells(counts: bytes | None) -> bytes | None:
    """The counts in the least number of cells."""
    return None if counts is None else folded(counts, CELLS[0]).astype("<u2").tobytes()


def may_link_coarsely(n: int, counts: bytes, m: int, other: bytes) -> bool:
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    apart = np.frombuffer(counts, "<u2").astype(np.int64) - np.frombuffer(other, "<u2")
    return 7 * int(np.abs(apart).sum()) <= n + m


def band(n: int) -> int:
    return n.bit_length() - 1


def layout(instance: int) -> tuple[int, int, int]:
    """(groups, parts, chosen) of the partitions for the band of the larger set."""
    largest = (2 << instance) - 1
    most = 2 * largest // 7
    if most <= 2:  # few differences: one group, subsets of all but ``most`` parts
        return (1, 1, 1) if not most else (1, most + 3, 3)
    return -(-largest // 5) + 1, 2, 1


def signatures(members: np.ndarray) -> np.ndarray:
    """The signatures that a set emits, as 64-bit numbers."""
    n = len(members)
    if not n:
        return members
    own = band(n)
    out = []
    for instance in (own, own + 1):
        if instance > own and 100 * n < PERCENT * (1 << instance):
            break
        groups, parts, chosen = layout(instance)
        partner = min((2 << instance) - 1, 100 * n // PERCENT)
        keep = (n + partner) // 7 * comb(parts - 1, chosen - 1) + 1
        total = groups * parts
        part = ((members >> np.uint64(32)) * np.uint64(total)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(start, n))
        content = mix(np.add.reduceat(mix(members + _B), start) ^ (part[start] * _A) ^ np.uint64(instance + 1))
        if chosen > 1:
            at = {int(p): i for i, p in enumerate(part[start])}
            rows = [[at[p] for p in subset if p in at] for subset in combinations(range(parts), chosen)]
            some = [(k, r) for k, r in enumerate(rows) if r]
            content = np.array([content[r].sum(dtype=np.uint64) for _, r in some], dtype=np.uint64)
            content = mix(content * _C + np.array([k + 1 for k, _ in some], dtype=np.uint64))
            size = np.array([size[r].sum() for _, r in some], dtype=np.int64)
        rank = ((np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(56)) | (content >> np.uint64(8))
        if len(rank) > keep:
            content = content[np.argpartition(rank, keep - 1)[:keep]]
        elif len(rank) < keep and len(rank) < groups * comb(parts, chosen):
            content = np.append(content, mix(np.array([instance + 1], dtype=np.uint64) * _C))
        out.append(content)
    return np.concatenate(out)


def placed(sig: np.ndarray, parts: int) -> np.ndarray:
    """A signature's partition, and 32 bits of its place there. Few signatures of a partition fall together by chance; that
    only makes pairs which the filters drop."""
    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part << np.uint64(32) | (sig * np.uint64(parts)) >> np.uint64(32)


def stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct signatures; least node of each; pairs of the least node and another one of the same signature;
    whether a signature of the pair has more than those two; which of 64 bits the pair's signatures set).

    The lowest bit of a node marks that it stands for several nodes already; the bit of a least node that is
    returned says the same. A signature whose only node comes marked more than once has other nodes in several
    tasks that met nothing but the least one: it gives the pair of the least node with itself.
    """
    if not len(sig):
        none = np.zeros(0, dtype=np.int64)
        return sig, none, none, none, none.astype(bool), none
    order = np.argsort(sig)
    sig, marked = sig[order], node[order]
    node = marked & ~np.int64(1)
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    length = np.diff(np.append(start, len(sig)))
    least, top = np.minimum.reduceat(node, start), np.maximum.reduceat(node, start)
    head, last = np.repeat(least, length), np.repeat(top, length)
    several = np.logical_or.reduceat(((node != head) & (node != last)) | ((marked & 1) == 1), start)
    alone = np.repeat((least == top) & (np.add.reduceat(marked & 1, start) > 1), length)
    other = np.flatnonzero((node != head) | alone)
    a, b, more = head[other], node[other], np.repeat(several, length)[other]
    bits = (np.uint64(1) << (sig[other] & np.uint64(63))).view(np.int64)
    if len(a):
        order = np.lexsort((b, a))
        a, b, more, bits = a[order], b[order], more[order], bits[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        more, bits = np.logical_or.reduceat(more, first), np.bitwise_or.reduceat(bits, first)
        a, b = a[first], b[first]
    return sig[start], least | ((least != top) | several), a, b, more, bits


PAIRS = "a long, b long"
PAIRS_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Rows on their way to the signatures' partitions: packed signatures and their nodes, packed pairs that a
#: task found by itself, and documents.
SIGNATURES, OWN_PAIRS, DOCUMENT = 0, 1, 2
PACKED = "part int, kind int, left binary, right binary, doc_id long, node long, n long, cells binary"
PACKED_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("left", pa.binary()), ("right", pa.binary()),
                           ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])
#: What comes out: pairs (a, b) with the stage that found them, whether a signature of theirs has more classes,
#: and in ``n`` the bits of their signatures; and documents.
MET = "kind int, a long, b long, more boolean, doc_id long, n long, cells binary"
MET_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_()),
                        ("doc_id", pa.int64()), ("n", pa.int64()), ("cells", pa.binary())])


def documents_and_pairs(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over the texts: a row per document (its class in ``a``), and pairs (a, b) where a is the least
    class met under some signature of b, by a task itself (kind OWN_PAIRS) or by the signature's partition. A
    class that is the only least one of a signature in several tasks is paired with itself."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held = 0

        def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 64):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 64]), PACKED_SCHEMA)]
                empty = [pa.nulls(len(columns[0]), f.type) for f in list(PACKED_SCHEMA)[4:]]
                yield pa.RecordBatch.from_arrays(columns + empty, schema=PACKED_SCHEMA)

        def flush() -> Iterator[pa.RecordBatch]:
            sig, least, a, b, more, bits = stars(placed(np.concatenate(sigs), parts), np.concatenate(nodes))
            cut = np.searchsorted(sig >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            rows = [(p, SIGNATURES, sig[cut[p]:cut[p + 1]].astype(np.uint32).tobytes(), least[cut[p]:cut[p + 1]].tobytes())
                    for p in range(parts) if cut[p] < cut[p + 1]]
            if len(a):
                rows.append((int(sig[0] % np.uint64(parts)), OWN_PAIRS, a.tobytes(), (b | more).tobytes() + bits.tobytes()))
            yield from packed(rows)

        for batch in batches:
            ids, done, rows = batch.column("doc_id"), 0, []
            for members in shingler.sets(batch.column("text").to_pylist()):
                node = fingerprint(members) if len(members) else None
                rows.append((node, len(members), cells(members) if len(members) else None))
                if len(members):
                    got = signatures(members)
                    sigs.append(got)
                    nodes.append(np.full(len(got), node, dtype=np.int64))
                    held += len(got)
                if len(rows) == 1000 or done + len(rows) == batch.num_rows:
                    k, (node, n, counts) = len(rows), zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(done, done + k) % parts, pa.int32()), pa.array([DOCUMENT] * k, pa.int32()),
                         pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), ids.slice(done, k),
                         pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary())],
                        schema=PACKED_SCHEMA)
                    done, rows = done + k, []
                if held >= FLUSH:
                    yield from flush()
                    sigs, nodes, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(kind: int, *found: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found[0]), 100_000):
                a, b, more, bits = (c[at:at + 100_000] for c in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(a), pa.int32()), pa.array(a), pa.array(b), pa.array(more, pa.bool_()),
                     pa.nulls(len(a), pa.int64()), pa.array(bits), pa.nulls(len(a), pa.binary())], schema=MET_SCHEMA)

        left, right = [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            of = {k: batch.take(pa.array(np.flatnonzero(kinds == k))) for k in (SIGNATURES, OWN_PAIRS, DOCUMENT)}
            left += [np.frombuffer(x, np.uint32) | np.uint64(p << 32) for p, x in zip(
                of[SIGNATURES].column("part").to_pylist(), of[SIGNATURES].column("left").to_pylist())]
            right += of[SIGNATURES].column("right").to_pylist()
            for x, y in zip(of[OWN_PAIRS].column("left").to_pylist(), of[OWN_PAIRS].column("right").to_pylist()):
                y, bits = np.split(np.frombuffer(y, np.int64), 2)
                yield from pairs(OWN_PAIRS, np.frombuffer(x, np.int64), y & ~np.int64(1), (y & 1) == 1, bits)
            d = of[DOCUMENT]
            if d.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [d.column("kind"), d.column("node"), pa.nulls(d.num_rows, pa.int64()), pa.nulls(d.num_rows, pa.bool_()),
                     d.column("doc_id"), d.column("n"), d.column("cells")], schema=MET_SCHEMA)
        met = stars(np.concatenate([np.zeros(0, np.uint64), *left]), np.frombuffer(b"".join(right), np.int64))
        yield from pairs(SIGNATURES, *met[2:])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, PACKED)
    return rows.repartitionById(parts, "part").mapInArrow(meet, MET)


@F.pandas_udf(BinaryType())
def _coarse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for counts in batches:
        yield counts.map(coarse_cells)


def _slot(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS))


def _picked(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The classes whose node is in ``nodes``, and a few others by chance: the same bitmap, so that the cells of classes that
    no pair names are not shuffled."""
    bits = nodes.select(_slot(F.col("node")).alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("__bits"))
    slotted = classes.withColumn("__slot", _slot(F.col("node"))).withColumn("__word", F.floor(F.col("__slot") / 64))
    hit = F.expr("(shiftright(__bits, CAST(__slot % 64 AS INT)) & 1L) = 1L")
    return slotted.join(F.broadcast(bits), "__word").filter(hit).select(*classes.columns)


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` plus __marked: true for every row whose doc_id is in ``ids``, and for a few others by chance.

    A bitmap of the ids, in a broadcast table of at most SLOTS / 64 rows; nothing is shuffled.
    """
    slot = _slot(F.col("doc_id").cast("long"))
    bits = stored(ids.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("__word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("__bits")))
    slotted = rows.withColumn("__slot", slot).withColumn("__word", F.floor(F.col("__slot") / 64))
    mark = F.expr("coalesce((shiftright(__bits, CAST(__slot % 64 AS INT)) & 1L) = 1L, false)")
    return slotted.join(F.broadcast(bits), "__word", "left").withColumn("__marked", mark).drop("__word", "__slot", "__bits")


def class_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """node, members (sorted shingle hashes as bytes) of the classes in ``nodes``.

    Texts are picked by a bitmap of the ids of one document per class before they
    are read again, so only wanted texts are shuffled, and a few by chance.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = _marked(picked, nodes.join(classes, "node").select("doc_id")).filter("__marked").select("text")
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            seen = {fingerprint(s): s.tobytes() for s in shingler.sets(batch.column("text").to_pylist()) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.binary())],
                                             schema=schema)

    sets = picked.mapInArrow(run, "node long, members binary")
    return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the exact filters, the least number of cells first: few pairs need the others."""
    for column, check in (("coarse", may_link_coarsely), ("cells", may_link)):
        both = pairs
        for end in ("a", "b"):
            own = _picked(classes.select("node", "n", column), pairs.select(F.col(end).alias("node")))
            both = both.join(own.select(F.col("node").alias(end), F.col("n").alias("n_" + end),
                                        F.col(column).alias("cells_" + end)), end)

        def run(batches: Iterator[pa.RecordBatch], check=check) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("n_a", "cells_a", "n_b", "cells_b")]
                keep = pa.array([check(*row) for row in zip(*columns)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=PAIRS_SCHEMA).filter(keep)

        pairs = stored(both.mapInArrow(run, PAIRS))
    return pairs


def links(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity of at least PERCENT / 100."""
    nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct())
    sets = class_sets(docs, nodes, classes)
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=PAIRS_SCHEMA).filter(
                pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, PAIRS))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component of ``found`` (node, component)."""
    a = found.select(F.col("node").alias("a"), F.col("component").alias("__a"))
    b = found.select(F.col("node").alias("b"), F.col("component").alias("__b"))
    got = pairs.join(a, "a", "left").join(b, "b", "left")
    return got.filter(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b")


def _blocks(members: DataFrame) -> DataFrame:
    """The classes under a root (root, node, n, cells) in groups (root, i, j) of two blocks each, with their ``own`` block."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.sum(F.octet_length("cells")).alias("bytes"))
    blocks = F.greatest(F.floor((F.col("size") - 1) / BLOCK), F.floor(F.col("bytes") / BLOCK_BYTES)) + 1
    rows = members.join(sizes, "root").withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "n", "cells")


def _candidates(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """root, i, j, a, b: in each group, pairs from different components that pass the exact filters. With ``most`` 0 a forest:
    none joins what the group's other pairs join already. Else each class names at most ``most`` larger ones, and ``more`` tells
    in all rows of the group whether a class had others.

    ``rows`` has ``_blocks``' columns; ``labels`` has per root, i, j and node the component, and ``wrong``: nodes known not to
    link with it. Kept apart, so that the cells are shuffled once.
    """
    schema = pa.schema([("root", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), *PAIRS_SCHEMA, ("more", pa.bool_())])

    def run(table: pa.Table, labels: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        order = np.lexsort((table["node"].to_numpy(), table["n"].to_numpy()))
        node, n, own = [table[c].to_numpy()[order] for c in ("node", "n", "own")]
        counts = [table["cells"][int(k)].as_py() for k in order]
        by_node = np.argsort(labels["l_node"].to_numpy())
        place = by_node[np.searchsorted(labels["l_node"].to_numpy()[by_node], node)]
        tree = labels["component"].to_numpy()[place].copy()
        wrong = [labels["wrong"][int(k)].as_py() for k in place]
        width = np.array([len(c) for c in counts])
        root, i, j = (table[c][0].as_py() for c in ("root", "i", "j"))
        a, b = [], []
        more = False
        for w in np.unique(width):  # a partner is at most a third larger, so it has as many cells or twice as many
            at = np.flatnonzero((width == w) | (width == 2 * w))
            fine = np.stack([folded(counts[k], int(w)) for k in at]).astype(np.int16)
            coarse = fine.reshape(len(at), max(1, int(w) // COARSE), -1).sum(axis=2, dtype=np.int16)
            size = n[at]
            for row in np.flatnonzero(width[at] == w):
                me = at[row]
                reach = np.searchsorted(size, 100 * size[row] // PERCENT, side="right")
                other = np.arange(row + 1, reach)
                other = other[(tree[at[other]] != tree[me]) & ((own[at[other]] != own[me]) if i != j else True)]
                if wrong[me] and len(other):
                    other = other[~np.isin(node[at[other]], np.array(wrong[me], dtype=np.int64))]
                for grid in (coarse, fine):
                    apart = np.abs(grid[other] - grid[row]).sum(axis=1, dtype=np.int64)
                    other = other[7 * apart <= size[other] + size[row]]
                if most:
                    more |= len(other) > most
                    other = other[:most]
                else:
                    trees, first = np.unique(tree[at[other]], return_index=True)
                    other = other[first]
                    if len(trees):
                        tree[np.isin(tree, trees)] = tree[me]
                for x in node[at[other]].tolist():
                    a.append(min(int(node[me]), x))
                    b.append(max(int(node[me]), x))
        k = len(a)
        return pa.Table.from_arrays([pa.array([root] * k, pa.int64()), pa.array([i] * k, pa.int32()), pa.array([j] * k, pa.int32()),
                                     pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([more] * k, pa.bool_())],
                                    schema=schema)

    return rows.groupBy("root", "i", "j").cogroup(labels.groupBy("l_root", "l_i", "l_j")).applyInArrow(
        run, "root long, i int, j int, " + PAIRS + ", more boolean")


def _joined(docs: DataFrame, around: DataFrame, ids: DataFrame, linked: DataFrame, found: DataFrame
            ) -> tuple[DataFrame, DataFrame]:
    """The links and components with those under the roots of ``around`` (root, node, n, cells)."""
    group = ["root", "i", "j"]
    rows = stored(_blocks(around))
    wrong = None
    most = 0
    while True:
        live = rows
        if wrong is not None:  # only groups that are not done
            live = rows.join(edges.select(*[F.col(c).alias("g_" + c) for c in group]).distinct(),
                             [F.col(c) == F.col("g_" + c) for c in group], "left_semi")
        labels = live.select(*[F.col(c).alias("l_" + c) for c in [*group, "node"]])
        labels = labels.join(found, F.col("l_node") == F.col("node"), "left").withColumn(
            "component", F.coalesce("component", "l_node")).drop("node")
        if wrong is None:
            labels = labels.withColumn("wrong", F.lit(None).cast("array<long>"))
        else:
            both = wrong.select(*group, F.col("a").alias("node"), F.col("b").alias("x")).unionByName(
                wrong.select(*group, F.col("b").alias("node"), F.col("a").alias("x")))
            both = both.groupBy(*group, "node").agg(F.collect_list("x").alias("wrong"))
            labels = labels.join(both, [F.col("l_" + c) == F.col(c) for c in [*group, "node"]], "left").drop(*group, "node")
        edges = stored(_candidates(live, labels, most))
        if edges.isEmpty():
            return linked, found
        good = links(docs, edges.select("a", "b").distinct(), ids)
        if not good.isEmpty():  # the components so far are stars already, so few rounds join them
            linked = linked.unionByName(good)
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(good))
        failed = stored(edges.join(good, ["a", "b"], "left_anti"))
        # groups go on whose forest has an edge that is no link, then those where a class had more partners
        edges = edges.filter("more") if most else failed
        if edges.isEmpty():
            return linked, found
        wrong = failed if wrong is None else stored(wrong.unionByName(failed))
        most = WIDER * max(1, most)


def _roots(staged: DataFrame, failed: DataFrame) -> DataFrame:
    """head: the least classes under which a pair failed that may hide another.

    A signature's classes form a tree: below the least of all are the least ones of
    other tasks (across), and below each of these, and below itself, the other
    classes of the task (within). A pair that fails matters where the tree has more
    classes than its two: marked so, or a task's own pair below or at a class that
    others were met by. A class met with itself (across) is the least one in several
    tasks, each of which has classes that the other tasks have not seen.
    """
    across = staged.filter((F.col("kind") == SIGNATURES) & F.col("more")).select("a", "b")
    broken = staged.join(failed, ["a", "b"], "left_semi")
    own_heads = broken.filter(F.col("kind") == OWN_PAIRS).select(F.col("a").alias("head")).distinct()
    above = across.join(own_heads, F.col("b") == F.col("head"), "left_semi").select(F.col("a").alias("head"))
    at = across.join(own_heads, F.col("a") == F.col("head"), "left_semi").select(F.col("a").alias("head"))
    return stored(broken.filter("more").select(F.col("a").alias("head")).unionByName(above).unionByName(at).distinct())


def _neighbourhoods(staged: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: the classes that may share a signature with each other in a tree under the root.

    A task's own pairs are followed where their signatures' bits meet those by which
    the root met the class above; signatures that are the same set the same bit.
    """
    across = staged.filter((F.col("kind") == SIGNATURES) & F.col("more"))
    within = staged.filter(F.col("kind") == OWN_PAIRS)
    below = stored(roots.join(across, F.col("head") == F.col("a")).select(
        F.col("head").alias("root"), F.col("b").alias("node"), F.col("bits").alias("by")))
    via = below.select("root", F.col("node").alias("via"), "by").unionByName(
        below.groupBy("root").agg(F.bit_or("by").alias("by")).select("root", F.col("root").alias("via"), "by"))
    deeper = via.join(within, (F.col("via") == F.col("a")) & (F.col("by").bitwiseAND(F.col("bits")) != 0))
    under = roots.join(within.filter("more"), F.col("head") == F.col("a")).select(
        F.col("head").alias("root"), F.col("b").alias("node"))
    own = roots.select(F.col("head").alias("root"), F.col("head").alias("node"))
    return stored(own.unionByName(under).unionByName(below.select("root", "node")).unionByName(
        deeper.select("root", F.col("b").alias("node"))).distinct())


def _grouped(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, node, component (the least class of its group), n_shingles, component_id."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-n_bytes // (12 * PER_PARTITION)))  # about one signature for two words
    met = stored(documents_and_pairs(docs, int(parts)))
    sets = met.filter(F.col("kind") == DOCUMENT).select("doc_id", F.col("a").alias("node"), "n", "cells")
    classes = stored(sets.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cells").alias("cells"))
        .withColumn("coarse", _coarse("cells")))
    ids = classes.select("node", "doc_id")
    staged = stored(met.filter(F.col("kind") != DOCUMENT).groupBy("kind", "a", "b").agg(
        F.max("more").alias("more"), F.bit_or("n").alias("bits")))
    pairs = staged.filter("a <> b").select("a", "b").distinct()
    nearest = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    linked = links(docs, possible(nearest, classes), ids)
    found = components(linked)
    rest = _apart(pairs.join(nearest, ["a", "b"], "left_anti"), found)
    linked = linked.unionByName(links(docs, possible(rest, classes), ids))
    found = components(linked)
    # Neighbourhoods of one large group of near copies are alike, and comparing one joins most of the group. So
    # first only the roots that are the least one of some class, then those that are still unsettled.
    done = None
    for _ in range(2):
        failed = stored(_apart(pairs, found))
        roots = _roots(staged, failed)
        if done is None:
            least = pairs.join(roots, F.col("a") == F.col("head"), "left_semi").groupBy("b").agg(F.min("a").alias("head"))
            done = roots = stored(least.select("head").distinct())
        else:
            roots = roots.join(done, "head", "left_anti")
        around = _neighbourhoods(staged, roots)
        around = around.join(_picked(classes.select("node", "n", "cells"), around), "node")
        linked, found = _joined(docs, around, ids, linked, found)
    named = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("__node"), "component", "component_id")
    return sets.join(named, F.col("node") == F.col("__node"), "left").select(
        "doc_id", "node", "component", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


@F.pandas_udf(LongType())
def _class_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    shingler = Shingler()
    for texts in batches:
        yield pd.Series([fingerprint(s) if len(s) else None for s in shingler.sets(texts.tolist())], dtype="object")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the least id of each group, columns unchanged; documents without words stay.

    Of rows with one id, one stays of each group; texts that no link joins stay each. Rows with a null id stay, all of them:
    nothing tells which of them the least is.
    """
    groups = stored(_grouped(docs))
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = stored(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        marked = _marked(docs, gone)
        # texts that no bit marks stay without being shuffled; the marked ones are looked up
        return marked.filter("not __marked").select(*columns).unionByName(
            marked.filter("__marked").join(gone, "doc_id", "left_anti").select(*columns))
    # an id does not name one text here: marked rows are looked up by id and class
    marked = _marked(docs, gone.unionByName(again))
    rows = marked.filter("__marked").select(
        F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _class_of("text").alias("class"))
    places = groups.filter("doc_id is not null").distinct()
    found = rows.filter("id is not null").join(
        places, (F.col("id") == F.col("doc_id")) & F.col("class").eqNullSafe(F.col("node")))
    found = found.filter("component_id = doc_id").dropDuplicates(["id", "component"])
    kept = found.select("row").unionByName(rows.filter("id is null").select("row"))
    return marked.filter("not __marked").select(*columns).unionByName(
        kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
