import json
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import packing, token_counts, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(r):
    out = [t for _, t, _, _ in EDGE]
    for _ in range(150):
        out.append("".join(r.choice((" ", "  ", "\n", " \n ", "\t", "", "\xa0", "'s ", "\u3000", "<|endoftext|>", "é1²"))
                           + w for w in prose(r, r.randint(0, 60))))
    return out + [" ", "\n", "a", "<|endoftext|>", "\U0001f600" * 50, "word " * 9000, "aaaa" * 3000]


def test_proofs():
    v = tokens.read_vocabulary()
    assert v.alike and " the" in v.whole and "<|endoftext|>" not in v.whole
    file = json.loads(v.file)
    file["model"]["merges"] = file["model"]["merges"][::-1]
    assert not tokens.merges_alike(file)


def test_counts_match_the_library(spark, library):
    every = texts(random.Random(1))
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(every)], **CLASHING)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert len(got) == len(every)
    for i, text in enumerate(every):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_without_the_proof_the_library_merges_all(library):
    v = tokens.read_vocabulary()
    encoder = tokens.Encoder(tokens.Vocabulary(v.file, v.whole, False))
    every = texts(random.Random(6))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in every]
    assert list(encoder.counts(every)) == [len(w) for w in want]
    assert list(encoder.ids(every)) == [array("I", w).tobytes() for w in want]


def test_packing(spark, library):
    r = random.Random(8)
    every = texts(r) + [" ".join(prose(r, r.choice((5, 50, 300, 1500)))) for _ in range(300)]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(every)], **CLASHING)
    rows = packing.pack(docs).collect()
    ids = {i: array("I", library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in enumerate(every)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in rows:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert zlib.crc32(ids[p["doc_id"]][p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) == len(ids[d])
        assert all(p["length"] == 1024 for p in pieces[1:]) and len(pieces) == -(-len(ids[d]) // 1024)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) <= 1024
    free = []  # offline best fit, longest piece first
    for length in sorted((p["length"] for p in rows), reverse=True):
        room = min((f for f in free if f >= length), default=None)
        if room is not None:
            free.remove(room)
        free.append((room or 1024) - length)
    assert len(by_sequence) <= 1.02 * len(free) + 1


def test_packing_edges(spark):
    docs = documents(spark, EDGE)
    rows = packing.pack(docs).collect()
    assert sum(p["doc_id"] == 5 for p in rows) == 2 and sum(p["doc_id"] is None for p in rows) == 1
    assert [p["length"] for p in rows if p["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(docs.limit(0)).count() == 0


def test_bins_are_bounded_and_best_fit():
    got = list(packing.best_fit_bins(iter([6, 7, 3, 4, 5, 10, 1]), size=10, open_bins=2))
    # 6|, 7|, 3 goes to the bin with least room (7), 4 fills the other, 5 opens, 10 fills one of its own, 1 joins 5
    assert got == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 5)]
    closed = list(packing.best_fit_bins(iter([6, 7, 8, 4]), size=10, open_bins=2))
    assert closed == [(0, 0), (1, 0), (2, 0), (0, 6)]  # the bin with 8, the fullest, closed first
