"""Suffix-array dedup against a count of all windows, and its parts against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import suffix_dedup
from vitrine.llm.suffix_hash import PrefixHashes, suffix_order


def brute(rows, width=suffix_dedup.WINDOW):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(d[p:p + width] for _, d in data for p in range(len(d) - width + 1))
    out = []
    for doc_id, d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for p in range(len(d) - width + 1):
            if seen[d[p:p + width]] > 1:
                gone[p:p + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(bool(gone[p]) and (p == 0 or not gone[p - 1]) for p in range(len(d)))
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **extra):
    return sorted((tuple(r) for r in suffix_dedup.dedup(documents(spark, rows, **extra)).collect()), key=str)


def corpus(seed):
    """Shared passages of many lengths, near copies, copies, loops inside a text, bytes of several alphabets."""
    r = random.Random(seed)
    passages = [" ".join(prose(r, k)) for k in (8, 20, 40, 45, 60, 90, 200)] + ["é中 " * 80, "z" * 450, "ab" * 230]
    rows = []
    for i in range(120):
        parts = [" ".join(prose(r, r.randint(0, 60)))]
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3) if r.random() < 0.4 else 0
            parts += [p[a:len(p) - (r.randint(0, len(p) // 3) if r.random() < 0.4 else 0)], " ".join(prose(r, r.randint(0, 40)))]
        rows.append((i, r.choice((" ", "", "\n")).join(parts), "en", "a"))
    for i in range(120, 150):  # near copies: one letter changed
        text = rows[i - 60][1]
        at = r.randrange(len(text) + 1)
        rows.append((i, text[:at] + "#" + text[at + 1:], "en", "b"))
    for i in range(150, 165):
        rows.append((i, rows[i - 100][1], "en", "b"))
    return rows + [rows[3], (None, rows[4][1], "en", "a"), *EDGE, *EDGE[:3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 60 and sum(0 < w[2] < w[1] for w in want) > 30
    assert got(spark, rows, **CLASHING) == want


def test_hot_grams_and_small_blocks(spark, monkeypatch):
    """Every contested gram is hot, blocks and pieces are small: other ways, same rows."""
    rows = corpus(3)
    want = brute(rows)
    for name, value in (("HOT", 1), ("HOT_BLOCK", 7), ("BLOCK", 3000), ("PIECE", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert got(spark, rows) == want


def test_empty_and_short(spark):
    rows = [(1, "a" * 199, "en", "a"), (2, "a" * 199, "en", "a"), (3, "b" * 200, "en", "a"), (4, "c" * 201, "en", "a"),
            (5, "d" * 200, "en", "a"), (6, "d" * 200, "en", "a")]
    assert got(spark, rows) == brute(rows)
    assert suffix_dedup.dedup(documents(spark, rows).limit(0)).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    for trial in range(12):
        n = int(rng.integers(200, 1500))
        data = rng.integers(97, (98, 99, 120)[trial % 3], n).astype(np.uint8)
        grams = PrefixHashes().read(data).grams(suffix_dedup.GRAM)
        windows = np.arange(n - suffix_dedup.WINDOW + 1)
        own = np.empty(len(windows), dtype=int)
        for s, e, a in zip(*suffix_dedup.anchored(grams, windows)):
            own[s:e + 1] = a
        assert own.tolist() == [p + int(np.argmin(grams[p:p + suffix_dedup.SPAN])) for p in windows]


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 400))
        data = rng.integers(97, 99 if trial % 2 else 110, n).astype(np.uint8)
        raw, m = data.tobytes(), int(rng.integers(1, n + 1))
        start = np.sort(rng.choice(n, m, replace=False))
        end = np.minimum(n, start + rng.integers(1, 50, m))
        group = rng.integers(0, 1 + trial % 4, m)
        hashes = PrefixHashes().read(data)
        want = sorted(range(m), key=lambda i: (group[i], raw[start[i]:min(end[i], start[i] + 20)], i))
        assert suffix_order(hashes, start, end, 20, group).tolist() == want
        x, y = rng.integers(0, n, 50), rng.integers(0, n, 50)
        most = n - np.maximum(x, y)
        common = [next((k for k in range(m) if raw[a + k] != raw[b + k]), m) for a, b, m in zip(x, y, most)]
        assert hashes.extension(x, y, most).tolist() == common


def test_equal_hashes_are_no_proof(monkeypatch):
    """With hashes that always agree, only equal bytes count."""
    monkeypatch.setattr(PrefixHashes, "equal", lambda self, x, y, length: np.ones(len(x), dtype=bool))
    context = [bytes([k]) * 64 + b"x" * 64 + bytes([c]) * 72 for k, c in ((1, 5), (1, 5), (1, 6))]
    one = np.ones(3, dtype=np.int64)
    hit = suffix_dedup.repeated_windows(PrefixHashes(), one, context, one, 64 * one)
    assert not hit[2]
