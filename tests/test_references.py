"""Reference counter: unit cases and a brute-force comparison on the driver's data."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vitrine.functions import references as refs
from vitrine.operators import references
from vitrine.sources import schemas
from vitrine.sources.fixtures import Catalogue

from conftest import SF_SMALL


def _variations(spark, rows):
    full = [(i, p, lab, "[]", 0, 0, 0, ref, False) for i, p, lab, ref in rows]
    df = spark.createDataFrame(full, "id long, product_id long, libelle string, attributs string, "
                                     "prix_supplement int, stock long, stock_utilise long, reference string, is_deleted boolean")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.VARIATIONS.fields])


def _assigned(spark, rows):
    out = references.assign_references(_variations(spark, rows)).collect()
    return {r.id: r.reference for r in out}


def test_unit_cases(spark):
    got = _assigned(spark, [(1, 7, "Été Rouge", None), (2, 7, "Été Rouge", None), (3, 7, "!!!", None)])
    assert got == {1: "PRD-000007-ETE-ROUGE", 2: "PRD-000007-ETE-ROUGE-02", 3: "PRD-000007-STANDARD"}
    got = _assigned(spark, [(1, 7, "A", None), (2, 7, "A 02", None), (3, 7, "A", None)])
    assert got == {1: "PRD-000007-A", 2: "PRD-000007-A-02", 3: "PRD-000007-A-03"}
    long_label = "B" * 200
    got = _assigned(spark, [(1, 7, long_label, None), (2, 7, long_label, None)])
    assert len(got[1]) == 100 and len(got[2]) == 100 and got[2].endswith("-02")


def test_stored_references_block_candidates(spark):
    # a stored reference (any case, deleted or not) takes the base
    got = _assigned(spark, [(1, 7, "x", "prd-000007-a"), (2, 7, "A", None), (3, 8, "A", None)])
    assert got == {2: "PRD-000007-A-02", 3: "PRD-000008-A"}


def _brute_force(rows):
    """The reference's loop: rows without reference in id order, probing every row."""
    def norm(r):
        return r.rstrip().upper()
    taken = {norm(r) for _, _, _, r in rows if r is not None}
    out = {}
    for vid, pid, base, ref in sorted(rows):
        if ref is not None:
            continue
        cand, n = base, 2
        while cand in taken:
            sfx = "-" + str(n).zfill(2)
            cand = base[:100 - len(sfx)] + sfx
            n += 1
        taken.add(cand)
        out[vid] = cand
    return out


def test_against_brute_force_on_driver_data(spark):
    v = Catalogue(spark, SF_SMALL).product_variations
    with_base = references.with_reference_base(v).select("id", "product_id", "base_reference", "reference").collect()
    rows = [(r.id, r.product_id, r.base_reference, r.reference) for r in with_base]
    expected = _brute_force(rows)
    got = {r.id: r.reference for r in references.assign_references(v).collect()}
    assert got == expected
    assert len(expected) > 0 and any(re.search(r"-\d\d$", x) for x in expected.values())


def test_family_is_shared_by_all_candidates(spark):
    bases = ["PRD-000007-A", "PRD-000007-A-02", "PRD-000007-" + "X" * 89, "PRD-000007-12-34", "PRD-000007-" + "1-" * 44 + "9"]
    rows = []
    for b in bases:
        b = b[:100]
        rows.append((b, b))
        for n in (2, 3, 99, 100, 101):
            sfx = "-" + str(n).zfill(2)
            rows.append((b, b[:100 - len(sfx)] + sfx))
    df = spark.createDataFrame(rows, "base string, cand string")
    out = df.select("base", refs.reference_family(F.lit(7), F.col("base")).alias("fb"),
                    refs.reference_family(F.lit(7), F.col("cand")).alias("fc")).collect()
    assert all(r.fb == r.fc for r in out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_of_bases(spark, seed):
    """Bases that are each other's candidates, several levels deep, with stored references in between; one hot product."""
    r = random.Random(seed)
    labels = ["A", "A 02", "A 03", "A 05", "A 02 02", "A 02 03", "A 03 02", "A 02 02 02", "A 99", "B", "B 02", "A 1"]
    rows, vid = [], 0
    for _ in range(700):
        vid += r.randint(1, 2)
        pid = r.choice((7, 7, 7, 8))
        if r.random() < 0.75:
            rows.append((vid, pid, r.choice(labels[:r.choice((2, 5, 12))]), None))
        else:
            n = r.choice((1, 2, 3, 4, 6))
            stored = f"PRD-{pid:06d}-" + r.choice(labels).replace(" ", "-") + ("" if n == 1 else f"-{n:02d}")
            rows.append((vid, pid, "x", r.choice((stored, stored.lower()))))
    df = _variations(spark, rows)
    based = references.with_reference_base(df).select("id", "product_id", "base_reference", "reference").collect()
    got = references.assign_references(df)
    assert {x.id: x.reference for x in got.collect()} == _brute_force([tuple(x) for x in based])


def test_chains_take_no_sequential_path(spark, monkeypatch):
    def refuse(batches):
        for pdf in batches:
            assert not len(pdf)
            yield pdf[["id"]].assign(product_id=0, reference="")
    monkeypatch.setattr(references, "_assign_partition", refuse)
    rows = [(i, 7, ("A", "A 02", "A 02 02")[i % 3], None) for i in range(1, 200)]
    assert len(_assigned(spark, rows)) == 199
