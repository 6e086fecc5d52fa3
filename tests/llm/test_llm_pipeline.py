"""Queries and the pipeline over small tables of the driver's shape."""

import random

import duckdb
import pytest

import corpus_pipeline
from conftest import SF_SMALL
from llm_data import CLASHING, EDGE, documents, prose
from vitrine.llm import langid, mixing, partenum, quality_rules
from vitrine.llm.queries import ORACLE_SQL, QUERIES


def tables(spark, path, r):
    rows, labels = [], []
    for i in range(260):
        words = prose(r, r.randint(25, 200))
        if i % 20 == 0:
            words = words[:5]
        rows.append((i, " ".join(words), ("en", "fr")[i % 2], f"src{i % 3 if i % 2 else 0}"))
        labels.append((i, int(i % 20 != 0), 0))
    rows += [(1000 + k, rows[k][1] + " tail", "en", "src0") for k in range(1, 60, 2)]
    documents(spark, rows, row="x", node=1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages_act_on_what_came_before(spark, tmp_path):
    rows = tables(spark, str(tmp_path), random.Random(1))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "mix_sources", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = sorted(r["doc_id"] for r in docs.collect())
    long_enough = sorted(d for d, t, *_ in rows if len(t.split()) >= 20)
    assert seen["quality_rules"] == long_enough
    assert set(seen["language_id"]) <= set(long_enough) and len(seen["language_id"]) >= 0.99 * len(long_enough)
    groups = partenum.linked_groups(spark.read.parquet(f"{tmp_path}/out-language_id")).collect()
    assert seen["near_duplicates"] == sorted(g["doc_id"] for g in groups if g["component_id"] == g["doc_id"])
    assert not [d for d in seen["near_duplicates"] if d >= 1000]
    plan = mixing.mix(spark.read.parquet(f"{tmp_path}/out-near_duplicates")).collect()
    assert seen["mix_sources"] == sorted(p["doc_id"] for p in plan for _ in range(p["repeats"]))
    assert set(seen["best_fit_packing"]) == set(seen["mix_sources"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13


def test_columns_of_the_contract(spark):
    want = {"op1": "doc_id held_out score predicted", "op2": "query_id rank vec_id score",
            "op3": "doc_id n_shingles component_id", "op4": "page_id url text n_chars",
            "op5": "doc_id size source_size target taken",
            "op6": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
            "op7": "doc_id n_bytes n_tokens over_limit", "op8": "page_id host path rule verdict",
            "op9": "doc_id piece start length ids_crc32 sequence_id offset", "op10": "doc_id held_out lang_pred score",
            "op11": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
            "op12": "doc_id n_bytes n_removed n_spans kept_sha256", "op13": "vec_id code error label_error codebooks_sha256"}
    rows = {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet").count() for n in ("documents", "pages", "embeddings")}
    for name, build in QUERIES.items():
        df = build(spark, SF_SMALL)
        assert set(want[name.split("_")[0]].split()) <= set(df.columns), name
        table = {"op4": "pages", "op8": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
        if name.split("_")[0] not in ("op2", "op9"):
            assert df.count() == rows[table], name


def test_unused_models_are_not_shared():
    assert langid.train([], []) is None and quality_rules.ALPHA < 0.05


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, and no rows at all, through all stages."""
    r = random.Random(3)
    text = " ".join(prose(r, 60))
    rows = EDGE + [(None, text, "en", "a"), (None, text, "en", "a"), (50, text, "en", None), (50, text, "en", None),
                   (51, " ".join(prose(r, 80)), None, "a")] + [(100 + i, " ".join(prose(r, 40)), "en", "b") for i in range(80)]
    for name, table in (("odd", rows), ("none", [])):
        docs = documents(spark, table, **CLASHING)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(100 + i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(
            f"{tmp_path}/{name}/labels.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if not table:
            assert pieces == []
            continue
        kept = {p["doc_id"] for p in pieces}
        # the mix leaves some documents of a source out; the others are there, and none that a rule rejects
        assert {50, 51} & kept and len(kept & set(range(100, 180))) >= 40 and not kept & {1, 2, 3, 4, 5, 8, 9}
        # rows without an id are never dropped as copies, whatever else holds their text
        one = partenum.one_of_each_group(docs)
        assert one.columns == docs.columns
        assert one.filter("doc_id is null").count() == 3 and one.filter("doc_id = 50").count() == 1
