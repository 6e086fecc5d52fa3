"""Randomised properties checked in one Spark job each (fixed seeds)."""

import random

from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions import references as refs

PHP_WS = " \t\n\r\0\x0b"


def _random_label(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.3:   # runs of digit groups, the hard case for the family key
        return " ".join(rng.choice(["1", "02", "99", "100", "7", "A", "x1"]) for _ in range(rng.randint(1, 45)))
    if kind < 0.5:   # long labels that get cut
        return "".join(rng.choice("abcdefghij -0123456789") for _ in range(rng.randint(80, 140)))
    alphabet = "aAbBzZ09 -_.,!Éèçß"
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))


def test_family_is_shared_by_every_candidate(spark):
    rng = random.Random(7)
    labels = [(rng.choice([7, 42, 123456, 1234567]), _random_label(rng)) for _ in range(600)]
    bases = spark.createDataFrame(labels, "pid long, label string").select(
        "pid", refs.reference_base(F.col("pid"), F.col("label")).alias("base")).collect()
    rows = []
    for r in bases:
        for n in (2, 3, 9, 10, 42, 99, 100, 101, 250):
            sfx = "-" + str(n).zfill(2)
            rows.append((r.pid, r.base, r.base[:100 - len(sfx)] + sfx))
    df = spark.createDataFrame(rows, "pid long, base string, cand string")
    bad = df.filter(refs.reference_family(F.col("pid"), F.col("base"))
                    != refs.reference_family(F.col("pid"), F.col("cand")))
    assert bad.count() == 0
    assert all(len(r.base) <= 100 for r in bases)


def _model_pairs(names, values):
    out, seen = {}, set()
    for i, name in enumerate(names):
        name = (name or "").strip(PHP_WS)
        value = ((values[i] if i < len(values) else None) or "").strip(PHP_WS)
        if name == "" or value == "" or name.lower() in seen:
            continue
        seen.add(name.lower())
        out[name] = value
    return out


def test_attribute_pairs_match_model(spark):
    rng = random.Random(11)
    pool_n = ["Couleur", "couleur", " COULEUR ", "Taille", "", "  ", "Matière", "matière", None]
    pool_v = ["Rouge", " Bleu ", "", "\t", "M", None, "XL"]
    rows = []
    for i in range(400):
        names = [rng.choice(pool_n) for _ in range(rng.randint(0, 6))]
        values = [rng.choice(pool_v) for _ in range(rng.randint(0, 6))]
        rows.append((i, names, values))
    df = spark.createDataFrame(rows, "id long, n array<string>, v array<string>")
    got = {r.id: r.m for r in df.select("id", attrs.normalise_pairs(F.col("n"), F.col("v")).alias("m")).collect()}
    for i, names, values in rows:
        assert got[i] == _model_pairs(names, values), (names, values)


def _brute_references(rows):
    """The reference's loop over rows without reference, in id order; a stored
    reference blocks a candidate whatever its case or trailing spaces."""
    taken = {r.rstrip().upper() for _, _, _, r in rows if r is not None}
    out = {}
    for vid, pid, base, ref in sorted(rows):
        if ref is not None or pid is None:
            continue
        cand, n = base, 2
        while cand in taken:
            sfx = "-" + str(n).zfill(2)
            cand = base[:100 - len(sfx)] + sfx
            n += 1
        taken.add(cand)
        out[vid] = cand
    return out


def test_counter_matches_brute_force_with_stored_suffixes(spark):
    from vitrine.operators import references
    from vitrine.sources import schemas

    rng = random.Random(23)
    labels = ["A", "A 02", "a-2", "B", "Lot B", "Été", "x" * 120]
    rows, vid = [], 0
    for _ in range(900):
        vid += rng.randint(1, 3)
        pid = rng.choice([1, 2, 3, 7])
        label = rng.choice(labels)
        if rng.random() < 0.45:
            rows.append((vid, pid, label, None))
        else:
            base_label = rng.choice(labels)
            base = "PRD-%06d-" % pid + base_label.upper().replace(" ", "-").replace("É", "E")[:89]
            n = rng.choice([1, 1, 2, 3, 4, 5, 7, 12, 100])
            ref = base if n == 1 else base[:100 - len("-%02d" % n)] + "-%02d" % n
            ref = rng.choice([ref, ref.lower(), ref + "  "])
            rows.append((vid, pid, label, ref))
    full = [(i, p, lab, "[]", 0, 0, 0, ref, False) for i, p, lab, ref in rows]
    df = spark.createDataFrame(full, "id long, product_id long, libelle string, attributs string, "
                                     "prix_supplement int, stock long, stock_utilise long, reference string, "
                                     "is_deleted boolean")
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.VARIATIONS.fields])
    based = references.with_reference_base(df).select("id", "product_id", "base_reference", "reference").collect()
    expected = _brute_references([(r.id, r.product_id, r.base_reference, r.reference) for r in based])
    got = {r.id: r.reference for r in references.assign_references(df).collect()}
    assert got == expected


def test_counter_with_numbered_labels(spark):
    """Labels ending in numbers ("T 42", "T 44") share a family but not candidates;
    chains ("T", "T 42", "T 42 02") do share them. Both must match the brute force."""
    from vitrine.operators import references
    from vitrine.sources import schemas

    rng = random.Random(5)
    labels = ["T 42", "T 44", "T", "T 42 02", "T 4", "T 100", "T 44 03", "U 12", "U"]
    rows, vid = [], 0
    for _ in range(1200):
        vid += rng.randint(1, 2)
        pid = rng.choice([1, 2, 9])
        if rng.random() < 0.5:
            rows.append((vid, pid, rng.choice(labels), None))
        else:
            base = "PRD-%06d-" % pid + rng.choice(labels).replace(" ", "-")
            n = rng.choice([1, 2, 3, 42, 44, 2, 5])
            ref = base if n == 1 else base + "-%02d" % n
            rows.append((vid, pid, rng.choice(labels), rng.choice([ref, ref.lower()])))
    full = [(i, p, lab, "[]", 0, 0, 0, ref, False) for i, p, lab, ref in rows]
    df = spark.createDataFrame(full, "id long, product_id long, libelle string, attributs string, "
                                     "prix_supplement int, stock long, stock_utilise long, reference string, "
                                     "is_deleted boolean")
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.VARIATIONS.fields])
    based = references.with_reference_base(df).select("id", "product_id", "base_reference", "reference").collect()
    expected = _brute_references([(r.id, r.product_id, r.base_reference, r.reference) for r in based])
    got = {r.id: r.reference for r in references.assign_references(df).collect()}
    assert got == expected
