import random

from pyspark.sql import functions as F

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import mixing


def water_fill(sizes, weights, most=3):
    """Targets by resharing the excess until none is above its cap."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**capped, **share}
        capped.update(over)


def rows_of(r):
    out, doc = [], 0
    for source, n in (("b", 60), ("a", 900), (None, 30), ("Z", 4), ("é", 200), ("c", 5)):
        for _ in range(n):
            out.append((doc, " ".join(prose(r, r.randint(0, 40))), "en", source))
            doc += 1
    return out


def test_targets_and_taken(spark):
    rows = rows_of(random.Random(3))
    docs = documents(spark, rows, **CLASHING)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(got) == len(rows)
    taken = {}
    for g in got:
        assert g["size"] == len(rows[g["doc_id"]][1].split())
        assert g["source_size"] == sizes[g["source"]]
        assert abs(g["target"] - want[g["source"]]) < 1e-6 * (1 + want[g["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"] and (not g["size"] or g["taken"] % g["size"] == 0)
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 40, (s, taken[s], t)  # within one document
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((g["doc_id"], g["taken"]) for g in got) == sorted((g["doc_id"], g["taken"]) for g in again)


def test_documents_repeat_as_planned(spark):
    rows = rows_of(random.Random(5))
    docs = documents(spark, rows, **CLASHING)
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert count == {d: n for d, n in plan.items() if n}


def test_edges(spark):
    docs = documents(spark, EDGE)
    got = mixing.mix(docs).collect()
    assert len(got) == len(EDGE)
    assert all(g["taken"] == 0 for g in got if g["size"] == 0)
    assert {g["doc_id"]: g["size"] for g in got}[8] == 5  # a no-break space is part of a word
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert [r["target"] for r in mixing.mix(blank).collect()] == [0.0, 0.0]
    assert blank.count() == 2 and mixing.mix(blank).agg(F.sum("taken")).first()[0] == 0
