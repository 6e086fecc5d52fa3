"""Ball k-means codes against Lloyd's rounds with all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from llm_data import CLASHING
from vitrine.llm import ball_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, **extra):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def brute(rows, rounds=ball_codes.ROUNDS):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    total, codes = [0] * len(kept), [""] * len(kept)
    every = []
    for p in range(4):
        xs = [v[p * width:(p + 1) * width] for _, v, _ in kept]
        book = [list(x) for x in xs[:256]]

        def best(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            at = [best(x)[1] for x in xs]
            for j in set(at):
                of = [x for x, a in zip(xs, at) if a == j]
                book[j] = [sum(c) // len(of) for c in zip(*of)]
        for k, x in enumerate(xs):
            d, j = best(x)
            total[k] += d
            codes[k] += f"{j:02x}"
        every += [str(c) for e in book for c in e]
    digest = hashlib.sha256(",".join(every).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, total):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, total)), key=str)


def got(spark, rows, **extra):
    return sorted((tuple(r) for r in ball_codes.codes(table(spark, rows, **extra)).collect()), key=str)


@pytest.mark.parametrize("coarse", [False, True])
def test_against_all_distances(spark, coarse):
    """With few distinct values many distances tie."""
    r = random.Random(5)
    value = (lambda: r.choice((-1, 0, 1)) / 512) if coarse else (lambda: r.gauss(0, 0.2))
    rows = [(r.randrange(10 ** 6), [value() for _ in range(8)], r.choice((1, 2, None))) for _ in range(600)]
    rows += rows[:20] + [(None, [value() for _ in range(8)], 1), (7, None, 1), (8, [0.1, None] * 4, 2),
                         (9, [math.nan] * 8, 2), (10, [math.inf] + [0.0] * 7, 2), (11, [], 1)]
    assert got(spark, rows, **{k: v for k, v in CLASHING.items()}) == brute(rows)


def test_few_vectors_other_lengths_and_none(spark):
    rows = [(i, [0.5 * i, -0.25, 0.0, 1.0], None) for i in range(5)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows + [(9, [1.0] * 8, 1), (10, [1.0] * 3, 1)]) == brute(rows)
    assert got(spark, []) == []


def test_large_components(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-200_000, 200_000) for _ in range(8)], 1) for i in range(300)]
    assert got(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="after scaling"):
        got(spark, [(1, [3e5] * 4, 1)])


def test_balls_spare_distances_and_lose_none():
    rng = np.random.default_rng(3)
    entries = rng.integers(-400, 400, (256, 4))
    x = (entries[rng.integers(0, 256, 5000)] + rng.integers(-40, 40, (5000, 4))).astype(np.int64)
    code, far = ball_codes.nearest(x, entries)
    start = np.where(rng.random(5000) < 0.9, code, rng.integers(0, 256, 5000))
    found, best, count = ball_codes.Balls(entries).nearest(x, start)
    assert (found == code).all() and (best == far).all()
    assert count < 5000 * 256 // 4
