"""Random batches give what a loop gives that applies one change after another (CHG-4..7, DQ-13)."""

import random
from decimal import Decimal

import pytest

from vitrine.functions.text import fold_key  # noqa: F401  (the rule that the loop restates)
from vitrine.operators import changes, quality
from vitrine.sources import schemas

M = quality.MSG
ADMIN, GONE = 1, 2
SUPPLIERS = [11, 12, 13]
KEY = "{}/" + "{:032x}" + ".png"


@pytest.fixture(scope="module")
def users(spark):
    rows = [(ADMIN, "N", "P", "admin@x.tn", "ROLE_ADMIN", None, False), (GONE, "N", "P", "gone@x.tn", "ROLE_ADMIN", None, True)]
    rows += [(s, "N", "P", f"s{s}@x.tn", "ROLE_FOURNISSEUR", "T", False) for s in SUPPLIERS]
    return spark.createDataFrame(rows, schemas.USERS)


def refused(result):
    return sorted((r["id"], r["seq"], r["reason"]) for r in result.collect())


def shuffled(r, rows):
    rows = list(rows)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_product_updates(spark, users, seed):
    r = random.Random(seed)
    stored = {i: dict(libelle="L", description="D", image=r.choice((None, "", f"old/{i}")), prix=Decimal("1.000"),
                      fournisseur_id=r.choice(SUPPLIERS)) for i in range(1, 9)}
    products = spark.createDataFrame([(i, p["libelle"], p["description"], p["image"], p["prix"], p["fournisseur_id"], False)
                                      for i, p in stored.items()], schemas.PRODUCTS)
    rows = []
    for seq in range(150):
        actor, sup = r.choice((ADMIN, ADMIN, GONE, *SUPPLIERS, *SUPPLIERS)), r.choice((*SUPPLIERS, *SUPPLIERS, 99))
        image = KEY.format(r.choice((actor, sup)), r.randrange(9)) if r.random() < 0.4 else None
        rows.append((r.choice((1, 1, 1, *range(1, 10))), f"L{seq}", "D", r.choice(("2", "3,5", "x")), sup,
                     r.choice((None, False, True)), image, actor, seq))
    state, reject, replaced = {i: dict(p) for i, p in stored.items()}, [], []
    for i, label, desc, prix, sup, remove, image, actor, seq in rows:
        p, admin = state.get(i), actor == ADMIN
        owner = sup if admin else actor
        why = (changes.PRODUCT_NOT_FOUND if p is None else changes.ACCOUNT_DISABLED if actor == GONE
               else changes.EDIT_DENIED if not admin and p["fournisseur_id"] != actor
               else M["price_pattern"] if prix == "x" else M["supplier_invalid"] if admin and sup == 99
               else M["image_invalid"] if image and not image.startswith(f"{owner}/") else None)
        if why:
            reject.append((i, seq, why))
            continue
        old = p["image"]
        p.update(libelle=label, prix=Decimal(prix.replace(",", ".")), fournisseur_id=owner)
        p["image"] = image if image else None if remove else old
        if old and old != p["image"]:
            replaced.append((i, old))
    result = changes.apply_product_updates(products, users, spark.createDataFrame(shuffled(r, rows), schemas.PRODUCT_UPDATES))
    assert refused(result.rejected) == sorted(reject)
    got = {x["id"]: x for x in result.snapshot.collect()}
    assert {i: {c: got[i][c] for c in p} for i, p in state.items()} == state
    assert sorted(tuple(x) for x in changes.replaced_image_keys(result).collect()) == sorted(replaced)


@pytest.mark.parametrize("seed", [1, 2])
def test_variation_changes(spark, users, seed):
    r = random.Random(seed)
    products = spark.createDataFrame([(i, f"P{i}", "D", None, Decimal("1"), SUPPLIERS[i % 3], i == 4) for i in range(1, 6)],
                                     schemas.PRODUCTS)
    owner = {i: SUPPLIERS[i % 3] for i in range(1, 6)}
    stored = {i: (r.randint(1, 5), r.random() < 0.2) for i in range(1, 9)}
    variations = spark.createDataFrame([(i, p, "V", "[]", Decimal("0"), 1, 0, f"OLD-{i}", d) for i, (p, d) in stored.items()],
                                       schemas.VARIATIONS)
    rows = [(r.choice((20, 20, *range(1, 30))), r.randint(1, 6), f"L{seq}", "[]", r.choice(("1", "1", "x")), "3",
             r.choice((ADMIN, ADMIN, GONE, *SUPPLIERS)), seq) for seq in range(150)]
    state, reject, first_label = {}, [], {}
    for i, asked, label, _, prix, _, actor, seq in rows:
        product, deleted = state[i][:2] if i in state else stored.get(i, (asked, False))
        why = (changes.ACCOUNT_DISABLED if actor == GONE else changes.VARIATION_NOT_FOUND if deleted
               else changes.PRODUCT_NOT_FOUND if product in (4, 6)
               else changes.VARIATION_DENIED if actor != ADMIN and owner[product] != actor
               else M["supplement_pattern"] if prix == "x" else None)
        if why:
            reject.append((i, seq, why))
        else:
            first_label.setdefault(i, label)
            state[i] = (product, False, label)
    result = changes.apply_variation_changes(variations, products, users,
                                             spark.createDataFrame(shuffled(r, rows), schemas.VARIATION_CHANGES))
    assert refused(result.rejected) == sorted(reject)
    got = {x["id"]: x for x in result.snapshot.collect()}
    assert set(got) == set(stored) | set(state)
    for i, (product, _, label) in state.items():
        want = f"OLD-{i}" if i in stored else f"PRD-{product:06d}-{first_label[i]}"
        assert (got[i]["product_id"], got[i]["libelle"], got[i]["reference"]) == (product, label, want)


@pytest.mark.parametrize("seed", [1, 2])
def test_intake(spark, users, seed):
    r = random.Random(seed)
    products = spark.createDataFrame([(1, "L", "D", None, Decimal("1"), 11, False)], schemas.PRODUCTS)
    rows = [(r.choice((10, 10, *range(1, 25))), f"L{seq}", "D", r.choice(("2", "x")), r.choice(("standard", "variations", "?")),
             "1", r.choice((*SUPPLIERS, 99)), r.choice((ADMIN, *SUPPLIERS)), None, seq) for seq in range(120)]
    state, reject = {}, []
    for i, label, _, prix, kind, _, sup, actor, _, seq in rows:
        why = (M["product_stored"] if i == 1 or i in state else M["type_invalid"] if kind == "?" else M["price_pattern"] if prix == "x"
               else M["supplier_invalid"] if actor == ADMIN and sup == 99 else None)
        if why:
            reject.append((i, seq, why))
        else:
            state[i] = (label, sup if actor == ADMIN else actor, kind == "standard")
    new, defaults, rejected = changes.intake(spark.createDataFrame(shuffled(r, rows), schemas.PRODUCT_INTAKE), users, products)
    assert refused(rejected) == sorted(reject)
    assert {x["id"]: (x["libelle"], x["fournisseur_id"]) for x in new.collect()} == {i: s[:2] for i, s in state.items()}
    assert {x["product_id"] for x in defaults.collect()} == {i for i, s in state.items() if s[2]}


def loop(stored, rows):
    held, state, reject = {i: e.rstrip().lower() for i, e in stored.items()}, {}, []
    for i, nom, _, email, _, _, seq in sorted(rows, key=lambda x: (x[6], x[0])):
        key = email.strip().lower()
        why = (M["email_taken"] if any(k == key for j, k in held.items() if j != i) else M["last_name_blank"] if nom == ""
               else None)
        if why:
            reject.append((i, seq, why))
        else:
            held[i], state[i] = key, email
    return {**stored, **state}, sorted(reject)


def run_users(spark, stored, rows, r):
    users = spark.createDataFrame([(i, "N", "P", e, "ROLE_ADMIN", None, False) for i, e in stored.items()], schemas.USERS)
    result = changes.apply_user_changes(users, spark.createDataFrame(shuffled(r, rows), schemas.USER_CHANGES))
    return {x["id"]: x["email"] for x in result.snapshot.collect()}, refused(result.rejected)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_user_changes(spark, seed):
    """Few addresses, many accounts: hand-overs, contests, stored doubles, refused changes in between."""
    r = random.Random(seed)
    mails = [f"m{k}@x.tn" for k in range(8)]
    stored = {i: r.choice((*mails, f"own{i}@x.tn")) for i in range(1, 8)}
    rows = [(r.randint(1, 12), r.choice(("N", "N", "N", "")), "P", r.choice((r.choice(mails), r.choice(mails).upper(), f"free{seq}@x.tn")),
             "ROLE_ADMIN", None, seq // 2) for seq in range(60)]
    rows = list({(x[0], x[6]): x for x in rows}.values())
    assert run_users(spark, stored, rows, r) == loop(stored, rows)


def test_a_chain_of_hand_overs_and_a_hot_address(spark):
    r = random.Random(4)
    stored = {i: f"m{i}@x.tn" for i in range(1, 7)}
    chain = [(i, "N", "P", f"m{i - 1}@x.tn" if i > 1 else "new@x.tn", "ROLE_ADMIN", None, i) for i in range(1, 7)]
    crowd = [(100 + i, "N", "P", r.choice(("HOT@x.tn", "hot@x.tn")), "ROLE_ADMIN", None, 10 + i) for i in range(80)]
    left = [(100, "N", "P", "cool@x.tn", "ROLE_ADMIN", None, 50)]
    rows = chain + crowd + left
    got = run_users(spark, stored, rows, r)
    assert got == loop(stored, rows)
    assert got[0][6] == "m5@x.tn" and sum(e.lower() == "hot@x.tn" for e in got[0].values()) == 1 and len(got[1]) == 78
