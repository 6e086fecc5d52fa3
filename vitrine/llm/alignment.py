"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

A (byte-level BPE) reads a space and the text, B (pieces) reads the text and adds the space
itself. Byte offsets where tokens of both end cut the text into groups; tokens whose bytes
overlap are linked. Between two neighbouring ends of either kind lies exactly one link, so the
links of many texts come from one sorted array of ends.

Identity map. The array ``same`` (built once from the two vocabularies) gives for each A id the B id
with the same bytes. A group of one A and one B token that it pairs is counted in a vector
as long as A's vocabulary; a task sends one such vector. Only links of other (irregular) groups
become pairs, distinct per block of texts with their numbers, and go through the shuffle.

Counts come back in three bounded or blockwise forms: the identity counts as vectors of A's vocabulary
length, the highest count per B id (one row per B id), and the counts of a block's own pairs, one row per pair and
block. A pair that a third of all texts hold is one row per block in every shuffle.

A's ids come from the fast merger where ``tokens.merges_alike`` proves it gives the library's ids and the
text has only ``tokens.PLAIN`` characters, else from the library; B's come from its library.

Defined cases: texts that are null, empty, or do not come back byte for byte (say, with U+2581)
have no tokens: zeros and an empty groups_sha256; special strings are plain text; very long texts are
aligned whole, in a block of their own; repeated rows count each; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import tokens
from vitrine.llm.common import ship_by_value, stored

ship_by_value(__name__)

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts in a block, and of texts that are aligned at once.
BLOCK, AT_ONCE = 3_000_000, 500_000
SPACE = "▁"
LOW = (1 << 32) - 1


def piece_bytes(piece: str) -> bytes:
    """The bytes of a B piece."""
    one = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(one[1], 16)]) if one else piece.replace(SPACE, " ").encode()


@dataclass
class Aligned:
    """Alignment of some texts. Arrays of links have the text's number first; links are in the order of the texts."""
    numbers: np.ndarray  # per text: tokens of A and B, groups, links
    sha: list[str]
    identity: tuple[np.ndarray, np.ndarray]  # text, A id
    other: tuple[np.ndarray, np.ndarray]  # text, A id << 32 | B id


class Aligner:
    """The two encoders of one task."""

    def __init__(self, a_file: str, b_model: bytes, proven: bool):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        file = json.loads(a_file)
        letters = tokens.byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token, i in (file["model"]["vocab"] | special).items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.same = self._identity()
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # an id's text with what may follow it in the written groups
        self.a_text = np.array([f"{i}{c}" for c in ",|" for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([f"{i}{c}" for c in ",;" for i in range(len(self.b_bytes))], dtype=object)
        self.is_plain = re.compile(tokens.PLAIN).fullmatch if proven else lambda text: None
        self.merger = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks=tokens.ranks_of(file)) if proven else None

    def _identity(self) -> np.ndarray:
        """For each A id the B id of the same bytes, or -1; of several, the one that is no single-byte fallback."""
        ids: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x and (x not in ids or self.b.is_byte(ids[x])) and not self.b.is_control(i) and not self.b.is_unknown(i):
                ids[x] = i
        return np.array([ids.get(x, -1) if x else -1 for x in self.a_bytes], dtype=np.int64)

    def a_ids(self, text: str) -> list[int]:
        if self.is_plain(text):
            return self.merger.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str | None]) -> Aligned:
        numbers = np.zeros((len(texts), 4), dtype=np.int64)
        sha = [""] * len(texts)
        at, a, b = [], [], []
        some = [k for k, t in enumerate(texts) if t]
        for k, y in zip(some, self.b.encode([texts[k] for k in some], num_threads=1) if some else []):
            x, raw = self.a_ids(" " + texts[k]), b" " + texts[k].encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) == raw == b"".join(map(self.b_bytes.__getitem__, y)):
                at.append(k)
                a.append(np.array(x, dtype=np.int32))
                b.append(np.array(y, dtype=np.int32))
        if not at:
            none = np.zeros(0, dtype=np.int64)
            return Aligned(numbers, sha, (none, none), (none, none))
        a_count, b_count = (np.array([len(x) for x in ids]) for ids in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])  # texts end to end
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
        left, right = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        both = ends[(a_end[left] == ends) & (b_end[right] == ends)]
        a_cut, b_cut = np.searchsorted(a_end, both) + 1, np.searchsorted(b_end, both) + 1
        a_from, b_from = np.concatenate([[0], a_cut[:-1]]), np.concatenate([[0], b_cut[:-1]])
        one = (a_cut - a_from == 1) & (b_cut - b_from == 1)
        one &= self.same[a[a_from]] == b[b_from]
        text_end = a_end[np.cumsum(a_count) - 1]
        group_text, link_text = np.searchsorted(text_end, both), np.searchsorted(text_end, ends)
        numbers[at] = np.stack([a_count, b_count, np.bincount(group_text), np.bincount(link_text)], axis=1)
        # the ids in the order of the written groups: a token of A comes after the B tokens of all groups before it
        a_place = np.arange(len(a)) + np.repeat(b_from, a_cut - a_from)
        b_place = np.arange(len(b)) + np.repeat(a_cut, b_cut - b_from)
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_cut - 1], b_last[b_cut - 1] = 1, 1
        written = np.empty(len(a) + len(b), dtype=object)
        for place, ids, last, names in ((a_place, a, a_last, self.a_text), (b_place, b, b_last, self.b_text)):
            written[place] = names[ids + last * (len(names) // 2)]
        stop = np.cumsum(a_count + b_count)
        for k, i, j in zip(at, (stop - a_count - b_count).tolist(), stop.tolist()):
            sha[k] = hashlib.sha256("".join(written[i:j].tolist())[:-1].encode()).hexdigest()
        irregular = ~one[np.searchsorted(both, ends)]
        of_text = np.array(at)
        pairs = a[left][irregular].astype(np.int64) << 32 | b[right][irregular]
        return Aligned(numbers, sha, (of_text[group_text[one]], a[a_from[one]].astype(np.int64)),
                       (of_text[link_text[irregular]], pairs))


#: Per document (kind DOCUMENT): numbers, sha, and its identity links and other links as steps between ascending numbers.
#: Per block the counts of its distinct pairs (kind PAIRS), and per task the identity counts (kind IDENTITY).
DOCUMENT, PAIRS, IDENTITY = 0, 1, 2
ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                  ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("identity", pa.binary()),
                  ("other", pa.binary()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
ROWS_DDL = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, "
            "identity binary, other binary, ids array<long>, counts array<long>")


def steps_by_text(texts: np.ndarray, values: np.ndarray, n: int) -> list[bytes]:
    """For each text its values in ascending order, each less the one before it."""
    order = np.lexsort((values, texts))
    values = values[order]
    end = np.cumsum(np.bincount(texts, minlength=n))
    begin = np.concatenate([[0], end[:-1]])
    steps = np.diff(values, prepend=0)
    some = begin < end
    steps[begin[some]] = values[begin[some]]
    return [steps[i:j].astype(np.uint32).tobytes() for i, j in zip(begin.tolist(), end.tolist())]


def from_steps(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each has."""
    count = np.array([len(r) // 4 for r in rows], dtype=np.int64)
    total = np.cumsum(np.frombuffer(b"".join(rows), np.uint32).astype(np.int64))
    begin = np.cumsum(count) - count
    before = np.concatenate([[0], total])[begin]
    return total - np.repeat(before, count), count


def block_rows(aligner: Aligner, block: int, docs: list[tuple[int | None, str | None]], identity: np.ndarray
               ) -> Iterator[pa.RecordBatch]:
    """The rows of a block; its identity links are added to ``identity``."""
    got, held, size, done = [], [], 0, 0
    for k, (_, text) in enumerate(docs):
        held.append(text)
        size += len(text or "")
        if size >= AT_ONCE or k + 1 == len(docs):
            got.append((done, aligner.align(held)))
            held, size, done = [], 0, k + 1
    texts, ids = (np.concatenate([x + (at if not c else 0) for at, g in got for x in (g.identity[c],)]) for c in (0, 1))
    identity += np.bincount(ids, minlength=len(identity))
    own = steps_by_text(texts, ids, len(docs))
    texts, ids = (np.concatenate([x + (at if not c else 0) for at, g in got for x in (g.other[c],)]) for c in (0, 1))
    pairs, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    other = steps_by_text(texts, index, len(docs))
    numbers, sha = np.concatenate([g.numbers for _, g in got]), [x for _, g in got for x in g.sha]
    n = len(docs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), pa.array([d for d, _ in docs], pa.int64()),
         *(pa.array(c) for c in numbers.T.copy()), pa.array(sha), pa.array(own, pa.binary()), pa.array(other, pa.binary()),
         pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=ROWS)
    if len(pairs):
        yield counted(PAIRS, block, pairs, counts)


def counted(kind: int, block: int | None, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, "block": block, "ids": ids, "counts": counts}], schema=ROWS)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
RESULT_DDL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, a_name: str = A_FILE, b_name: str = B_FILE) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import public_tokenizers
    with open(public_tokenizers.path(a_name), encoding="utf-8") as f:
        a_file = f.read()
    with open(public_tokenizers.path(b_name), "rb") as f:
        b_model = f.read()
    proven = tokens.merges_alike(json.loads(a_file))
    same = Aligner(a_file, b_model, False).same
    context = docs.sparkSession.sparkContext
    files = context.broadcast((a_file, b_model))  # plain text and bytes: executors need no class of this package

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value, proven)
        identity = np.zeros(len(aligner.a_bytes), dtype=np.int64)
        first = TaskContext.get().partitionId() << 24  # the rows are kept in a table, so a rerun of the task does no harm
        held: list[tuple] = []
        size = blocks = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((doc_id, text))
                size += len(text or "")
                if size >= BLOCK:
                    yield from block_rows(aligner, first + blocks, held, identity)
                    held, size, blocks = [], 0, blocks + 1
        if held:
            yield from block_rows(aligner, first + blocks, held, identity)
        some = np.flatnonzero(identity)
        if len(some):
            yield counted(IDENTITY, None, some, identity[some])

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, ROWS_DDL))
    listed = F.explode(F.arrays_zip("ids", "counts")).alias("x")
    own = rows.filter(F.col("kind") == PAIRS).select("block", listed).select("block", "x.*")
    vectors = rows.filter(F.col("kind") == IDENTITY).select(listed).select("x.*").groupBy("ids").agg(F.sum("counts").alias("counts"))
    one_to_one = np.zeros(len(same), dtype=np.int64)
    for i, n in vectors.collect():  # at most one row per A id
        one_to_one[i] = n
    some = np.flatnonzero(one_to_one)
    paired = docs.sparkSession.createDataFrame(
        [(int(i) << 32 | int(same[i]), int(one_to_one[i])) for i in some], "ids long, counts long")
    total = stored(own.select("ids", "counts").unionByName(paired).groupBy("ids").agg(F.sum("counts").alias("count")))
    best = total.groupBy(F.col("ids").bitwiseAND(LOW).alias("b")).agg(F.max("count").alias("most"))  # one row per B id
    marked = total.join(F.broadcast(best), F.col("ids").bitwiseAND(LOW) == F.col("b")).select(
        "ids", "count", (F.col("count") == F.col("most")).alias("best"))
    known = marked.join(F.broadcast(paired.select("ids")), "ids", "left_semi").collect()  # at most one row per A id
    same_count, same_best = np.zeros(len(same), dtype=np.int64), np.zeros(len(same), dtype=bool)
    for ids, count, is_best in known:
        same_count[ids >> 32], same_best[ids >> 32] = count, is_best
    vectors = context.broadcast((same_count, same_best))
    replies = own.select(F.col("block").alias("of"), "ids").join(marked, "ids")

    def finish(block: pa.Table, replies: pa.Table) -> pa.Table:
        same_count, same_best = vectors.value
        order = np.argsort(replies["ids"].to_numpy())  # the block's pairs, in the order of their numbers
        pair_count, pair_best = replies["count"].to_numpy()[order], replies["best"].to_numpy()[order]
        sums, bests = np.zeros(block.num_rows, dtype=np.int64), np.zeros(block.num_rows, dtype=np.int64)
        for column, count, best in (("identity", same_count, same_best), ("other", pair_count, pair_best)):
            ids, each = from_steps(block[column].to_pylist())
            end = np.cumsum(each)
            for out, values in ((sums, count[ids]), (bests, best[ids].astype(np.int64))):
                total = np.concatenate([[0], np.cumsum(values)])
                out += total[end] - total[end - each]
        columns = [block[c].combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*columns, pa.array(bests), pa.array(sums), block["sha"].combine_chunks()], schema=RESULT)

    of_block = rows.filter(F.col("kind") == DOCUMENT).select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "identity", "other")
    return of_block.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(finish, RESULT_DDL)
