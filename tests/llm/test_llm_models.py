import random
import zlib

import numpy as np

from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import langid, quality_model

ALPHABETS = {"aa": "ka lo mi ren ta sol", "bb": "zxu qwi vyo thj grr pfl", "cc": "éta ñor ção ühl søn åre"}


def text_of(r, lang, n):
    return " ".join("".join(r.choices(ALPHABETS[lang].split(), k=r.randint(1, 3))) for _ in range(n)) + "."


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_languages_held_out(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        lang = r.choice(list(ALPHABETS))
        rows.append((i, text_of(r, lang, r.randint(3, 60)), lang if i % 7 else None, "s"))
    truth = {i: next(a for a in ALPHABETS if any(s in t for s in ALPHABETS[a].split()[:1]) or a == lang)
             for i, t, lang, _ in rows if lang}
    docs = documents(spark, rows, **CLASHING)
    got = langid.identify(docs).collect()
    assert len(got) == 600 and all(0 <= g["score"] <= 1 and g["lang_pred"] in ALPHABETS for g in got)
    assert all(g["held_out"] == (fold(g["doc_id"], 4) == 2) for g in got)
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    right = sum(rows[g["doc_id"]][2] == g["lang_pred"] for g in held)
    assert len(held) > 80 and right >= 0.97 * len(held)
    assert sum(g["rejected"] for g in got) <= 0.02 * len(got)


def test_language_of_held_out_rows_is_never_learned(spark):
    r = random.Random(5)
    rows = [(i, text_of(r, "aa", 20), "aa", "s") for i in range(200)]
    marked = [(i, t, "zz" if fold(i, 4) == 2 else lang, s) for i, t, lang, s in rows]
    a, b = (sorted((g["doc_id"], g["lang_pred"], g["score"]) for g in langid.identify(documents(spark, x)).collect())
            for x in (rows, marked))
    assert a == b


def test_language_edges(spark):
    r = random.Random(6)
    docs = documents(spark, EDGE + [(100 + i, text_of(r, "aa", 9), "aa", "s") for i in range(80)], **CLASHING)
    got = {g["doc_id"]: g for g in langid.identify(docs).collect()}
    for i in (1, 2, 3, 9):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[8]["lang_pred"] != "und" and got[None]["held_out"] is False
    kept = langid.kept_documents(docs)
    assert kept.columns == docs.columns and not {1, 2, 3, 9} & {k["doc_id"] for k in kept.collect()}
    assert kept.filter("doc_id >= 100").count() >= 78
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = documents(spark, [(1, "word", None, "s")])
    assert [g["lang_pred"] for g in langid.identify(unlabelled).collect()] == ["und"]


def test_quality_held_out(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        words = text_of(r, "aa", r.randint(5, 60)).split()
        bad = r.random() < 0.2
        if bad:
            words = r.choice(([w + "$$$" for w in words], [w.upper() + "!!" for w in words], words[:1] * len(words)))
        rows.append((i, " ".join(words), "aa", "s"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    docs = documents(spark, rows, **CLASHING)
    marks = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {g["doc_id"]: g for g in quality_model.classify(docs, marks).collect()}
    assert len(got) == 900
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if fold(i, 5) == 0]
    assert all(got[i]["held_out"] == (fold(i, 5) == 0) for i in got)
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got.values())
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i]["predicted"] for i in held if truth[i])


def test_quality_edges(spark):
    docs = documents(spark, EDGE, **CLASHING)
    marks = spark.createDataFrame([(4, 1), (5, 1), (5, 0), (7, 1), (8, 0)], "doc_id long, quality int")
    got = quality_model.classify(docs, marks).collect()
    assert len(got) == len(EDGE) and all(0 <= g["score"] <= 1 for g in got)
    assert len({g["score"] for g in got if g["doc_id"] in (1, 2, 3)}) == 1
    none = quality_model.classify(docs, marks.limit(0)).collect()
    assert {(g["score"], g["predicted"]) for g in none} == {(0.5, 1)}
    assert quality_model.classify(docs.limit(0), marks).count() == 0


def test_score_is_the_sparse_dot_product():
    r = random.Random(1)
    texts = [text_of(r, "aa", 12) for _ in range(40)] + [text_of(r, "bb", 12) + "$$$" for _ in range(40)]
    w = quality_model.train(texts, [1] * 40 + [0] * 40)
    rows = next(quality_model.Words().block([texts[50]]))
    lists, extra = quality_model.features(rows)
    x = {}
    for at in lists:
        for slot in at:
            x[slot] = x.get(slot, 0) + 1 / len(at)
    dot = sum(v * w[s] for s, v in x.items()) + extra @ w[:quality_model.N_EXTRA]
    assert abs(dot - (extra @ w[:quality_model.N_EXTRA] + sum(w[at].mean() for at in lists))) < 1e-9
    assert dot < 0


def test_rejection_follows_the_quantile():
    r = random.Random(8)
    texts = [" ".join(prose(r, 5)) for _ in range(2000)]  # any language: no score is high
    languages = [r.choice("abcd") for _ in texts]
    assert 0 < langid.train(texts, languages).reject_below < 0.5
    assert langid.train(texts[:200], languages[:200]).reject_below == 0


def test_scorer_is_the_average_of_embeddings(spark):
    """The scorer adds up sums per word; plainly, it is the mean over all subwords of a text."""
    r = random.Random(9)
    texts = [text_of(r, lang, r.randint(1, 40)) for lang in ALPHABETS for _ in range(60)]
    languages = [lang for lang in ALPHABETS for _ in range(60)]
    model = langid.train(texts, languages)
    docs = documents(spark, [(i, t, None, "s") for i, t in enumerate(texts)] + [(500, "a " * 5000 + "zz", None, "s")])
    got = {g["doc_id"]: g for g in langid.identify(docs, model).collect()}
    for i, text in [*enumerate(texts), (500, "a " * 5000 + "zz")]:
        rows = np.concatenate([model.table[langid.subwords(w)] for w in text.lower().split()])
        z = (rows.mean(axis=0, dtype=np.float64) + model.bias) / model.temperature
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.languages[int(share.argmax())] and abs(got[i]["score"] - share.max()) < 1e-5
        assert got[i]["rejected"] == (share.max() < model.reject_below)

