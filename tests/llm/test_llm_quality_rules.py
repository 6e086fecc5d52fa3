import math
import random
import re

from pyspark.sql import functions as F

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import quality_rules as Q

SPACE = " \t\n\x0b\x0c\r"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words)}


def texts(r):
    out = [t for _, t, _, _ in EDGE]
    for _ in range(120):
        words = prose(r, r.randint(1, 90))
        if r.random() < 0.5:
            at, n = r.randrange(len(words)), r.randint(1, 20)
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words)):0] = words[at:at + n]
        out.append("".join(w + r.choice((" ", "\n", "\n", "  ", "\t", " | ", "# ")) for w in words))
    out.append("a b c d e f g h " * 3 + "z")
    return out


def test_measures_match_brute_force(spark):
    every = texts(random.Random(2))
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(every)], **CLASHING)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r.asDict() for r in Q.judge(docs, labels).collect()}
    assert len(got) == len(every)
    for i, text in enumerate(every):
        want = measures(text)
        assert {k: got[i][k] for k in want} == want, text
        assert got[i]["kept"] == (not want["base_failed"])  # no labels, no cutoffs


def test_binomial_tail(spark):
    cases = [(50, 0, 0.01), (400, 3, 0.02), (3000, 4, 0.004), (20000, 60, 0.004), (7, 7, 0.3), (5, 2, 0.5)]
    for n, x, p in cases:
        row = spark.createDataFrame([(float(n), x)], "n double, x long").select(
            Q._log_tail(F.col("n"), F.col("x"), p).alias("t")).first()
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                                  + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(x + 1))
        assert abs(row["t"] - math.log(want)) < 1e-6


def test_cutoffs_limit_false_rejection(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        words = prose(r, 25)
        if bad:
            words = [w + "***" for w in words]
        elif i % 500 == 1:
            words[0] += "#"
        rows.append((i, " ".join(words), "en" if i % 2 else None, "s"))
        labels.append((i, int(not bad), 0))
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {g["doc_id"]: g["kept"] for g in Q.judge(docs, marks).collect()}
    good = [i for i, q, _ in labels if q]
    assert sum(not got[i] for i in good) <= 0.02 * len(good)
    assert all(not got[i] for i, q, _ in labels if not q)
    few = Q.judge(docs, marks.limit(100)).filter("not kept").count()
    assert few == 0  # too few labels to prove any cutoff


def test_kept_documents(spark):
    every = texts(random.Random(4))
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(every)], **CLASHING)
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 1), (None, 0), (999, 1)], "doc_id long, quality int")
    out = Q.kept_documents(docs, labels)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, t in enumerate(every) if not measures(t)["base_failed"]}
    assert Q.kept_documents(docs.limit(0), labels).count() == 0
