import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import components, partenum


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """{doc_id: (n, component)} by comparing all that share a shingle."""
    sets = {}
    for d, t, *_ in rows:
        sets.setdefault(d, []).append(shingle_set(t))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    flat = [(d, s) for d, many in sets.items() for s in many if s]
    held = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            held[x].append(k)
    for k, (d, s) in enumerate(flat):
        common = defaultdict(int)
        for x in s:
            for o in held[x]:
                common[o] += o > k
        for o, n in common.items():
            if n and 100 * n >= 75 * (len(s) + len(flat[o][1]) - n):
                a, b = sorted((find(d), find(flat[o][0])))
                parent[b] = a
    return {d: find(d) for d in sets}


def family(r, base, copies):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randint(0, max(1, len(words) // 60))):
            at, what = r.randrange(len(words) + 1), r.random()
            if what < 0.4 and len(words) > at:
                words[at] = "edit" + str(r.random())
            elif what < 0.7:
                words.insert(at, "new" + str(r.random()))
            elif len(words) > 1:
                words.pop(at - 1)
        out.append(words)
    return out


def corpus(r):
    passage = prose(r, 70)
    texts = []
    for _ in range(60):
        texts += family(r, prose(r, r.choice((3, 5, 6, 8, 9, 12, 17, 25, 40, 80, 160, 400))), r.randint(1, 6))
    texts += family(r, prose(r, 120), 120)  # one large group of near copies
    for _ in range(150):  # a passage that many unlike documents share
        own = prose(r, r.randint(10, 120))
        at = r.randint(0, len(own))
        texts.append(own[:at] + passage + own[at:])
    words = prose(r, 60)
    for step in range(12):  # a chain: neighbours are alike, ends are not
        texts.append(words[4 * step:] + prose(random.Random(step), 0) + [f"t{k}" for k in range(4 * step)])
    r.shuffle(texts)
    rows = [(3 * i, r.choice((" ", "\n", "  ")).join(w.upper() if r.random() < 0.1 else w for w in t), "en", "s")
            for i, t in enumerate(texts)]
    return rows + [(5000 + i, rows[i][1], "fr", "x") for i in range(0, 60, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    got = {g["doc_id"]: g for g in partenum.linked_groups(documents(spark, rows, **CLASHING)).collect()}
    want = brute(rows)
    assert {d: g["component_id"] for d, g in got.items()} == want
    assert all(g["n_shingles"] == len(shingle_set(t)) for d, t, *_ in rows for g in [got[d]])


def test_neighbourhoods_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 16)
    monkeypatch.setattr(partenum, "FLUSH", 2000)
    rows = corpus(random.Random(3))
    got = {g["doc_id"]: g["component_id"] for g in partenum.linked_groups(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_groups_are_searched_again_only_for_partners_not_named(spark, monkeypatch):
    rows = corpus(random.Random(3))
    docs, want = documents(spark, rows), brute(rows)
    asked = []
    keep = partenum._candidates

    def watched(rows, labels, most):
        asked.append(most)
        return keep(rows, labels, most)
    monkeypatch.setattr(partenum, "_candidates", watched)
    got = {g["doc_id"]: g["component_id"] for g in partenum.linked_groups(docs).collect()}
    assert got == want
    assert partenum.WIDER in asked and max(asked) == partenum.WIDER  # no class has more partners than that
    monkeypatch.setattr(partenum, "WIDER", 1)
    asked.clear()
    got = {g["doc_id"]: g["component_id"] for g in partenum.linked_groups(docs).collect()}
    assert got == want
    assert asked.count(1) > asked.count(0)  # here some have


def test_no_pair_is_missed():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 63, 64, 100, 257, 900] * 12:
        a = np.unique(partenum.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        for b_size in {n, -(-3 * n // 4), 4 * n // 3}:
            # b shares o shingles with a, at the least overlap that still links
            o = next(o for o in range(min(n, b_size), -1, -1)
                     if 100 * (o - 1) < 75 * (n + b_size - o + 1)) if b_size else 0
            if not o or 100 * o < 75 * (n + b_size - o):
                continue
            fresh = partenum.mix(rng.integers(0, 2**63, b_size - o).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[:o], fresh]))
            assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size, (n, b_size, o)


def hidden_triples(r, n):
    """(hot, x, y): x and y link, neither links with hot, and hot is the least class of every signature they share."""
    shingler, out = partenum.Shingler(), []
    while len(out) < n:
        base = prose(r, r.randint(12, 20))
        triple = [base[r.randint(3, 6):], base + prose(r, 1), base + prose(r, 1)]
        hot, x, y = shingler.sets([" ".join(t) for t in triple])
        h, s, t = (shingle_set(" ".join(t)) for t in triple)
        if (partenum.fingerprint(hot) < min(map(partenum.fingerprint, (x, y))) and 4 * len(s & t) >= 3 * len(s | t)
                and 4 * max(len(h & s) / len(h | s), len(h & t) / len(h | t)) < 3
                and np.isin(np.intersect1d(partenum.signatures(x), partenum.signatures(y)), partenum.signatures(hot)).all()):
            out.append([" ".join(t) for t in triple])
    return out


def test_copies_in_every_task_hide_no_link(spark):
    rows = []
    for k, (hot, x, y) in enumerate(hidden_triples(random.Random(5), 4)):
        # the even ids are one task and the odd ids another: each has the hot class, and one of the near copies
        rows += [(10 * k + i, t, "en", "s") for i, t in enumerate((hot, hot, x, y))]
    docs = documents(spark, rows).repartitionById(2, (F.col("doc_id") % 2).cast("int"))
    got = {g["doc_id"]: g["component_id"] for g in partenum.linked_groups(docs).collect()}
    assert got == brute(rows)
    assert all(got[10 * k + 3] == 10 * k + 2 for k in range(4))


def test_edges(spark):
    docs = documents(spark, EDGE + [(11, "A  b\tC d e F", "en", "s"), (12, "ab ab ab ab ab ab", "en", "s")], **CLASHING)
    got = partenum.linked_groups(docs).collect()
    assert len(got) == len(EDGE) + 2
    by_id = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in got}
    assert [by_id[i] for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert by_id[5] == (1, 5) and by_id[7] == (1, 7) and by_id[12] == (1, 7)
    assert by_id[None] == (2, 11) and by_id[11] == (2, 11)  # equal sets, one without an id
    kept = partenum.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(k["doc_id"] or 0 for k in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 11]
    assert partenum.linked_groups(docs.limit(0)).count() == 0
    assert partenum.one_of_each_group(docs.limit(0)).count() == 0


def test_other_texts_of_a_repeated_id_stay(spark):
    rows = [(1, "a b c d e f g", "en", "s"), (2, "A b c d e f g", "en", "s"), (2, "one two three four five six", "en", "s"),
            (3, "x y z", "en", "s"), (3, "u v w", "en", "s"), (3, "u V w", "en", "s"), (4, "alone here", "en", "s")]
    kept = partenum.one_of_each_group(documents(spark, rows, **CLASHING)).collect()
    assert sorted((k["doc_id"], k["text"].lower()) for k in kept) == [
        (1, rows[0][1]), (2, rows[2][1]), (3, "u v w"), (3, "x y z"), (4, "alone here")]


def test_components(spark):
    r = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, 500 + i) for i in range(1, 300)]
    noise = [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(220)]
    links = chain + hub + noise + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {g["node"]: g["component"] for g in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    tables = []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df: (tables.append(1), keep(df))[1])
    chain = [(i, i + 1) for i in range(100, 160)] + [(159, 7), (500, 400), (450, 500)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {g["node"]: g["component"] for g in components.components(links).collect()}
    assert got == {**{i: 7 for i in (7, *range(100, 161))}, **{i: 400 for i in (400, 450, 500)}}
    assert len(tables) == 1


def test_components_of_links_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "_joined_in_tasks", lambda edges: edges)
    test_components(spark)
    monkeypatch.undo()
    monkeypatch.setattr(components, "FLUSH", 1)
    test_components(spark)
