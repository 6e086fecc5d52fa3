"""Properties: pages cover the listing, counts are consistent, jobs are idempotent."""

from pyspark.sql import functions as F

from vitrine.operators import changes, listing, quality
from vitrine.sources.fixtures import Catalogue

from conftest import SF_SMALL


def test_pages_union_is_listing(spark):
    c = Catalogue(spark, SF_SMALL)
    full = listing.product_rows(listing.product_listing(c.products, c.users)).select("id")
    total = full.count()
    ids = []
    for start in range(0, total + 20, 20):
        ids += [r.id for r in listing.product_page(c.products, c.users, c.product_variations, start, 20).collect()]
    assert sorted(ids) == sorted(r.id for r in full.collect())
    assert ids == sorted(ids, reverse=True)


def test_filtered_not_above_total(spark):
    c = Catalogue(spark, SF_SMALL)
    r = listing.product_counts(c.products, c.users, "red").first()
    assert 0 < r.records_filtered <= r.records_total
    r = listing.product_counts(c.products, c.users, "").first()
    assert r.records_filtered == r.records_total


def test_soft_delete_idempotent(spark):
    c = Catalogue(spark, SF_SMALL)
    once = changes.soft_delete(c.products, c.product_deletes)
    twice = changes.soft_delete(once, c.product_deletes)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.filter(F.col("is_deleted") == True).count() >= c.product_deletes.count()  # noqa: E712


def test_normalisation_idempotent(spark):
    c = Catalogue(spark, SF_SMALL)
    once = quality.normalise_products(c.product_intake)
    again = quality.normalise_products(once.withColumn("stock", F.col("stock_text")).drop("stock_text"))
    assert sorted(once.select("id", "libelle", "description", "prix").collect()) == \
        sorted(again.select("id", "libelle", "description", "prix").collect())


def test_variation_changes_keep_references_unique(spark):
    c = Catalogue(spark, SF_SMALL)
    snap = changes.apply_variation_changes(c.product_variations, c.products, c.users, c.variation_changes).snapshot
    new_refs = snap.join(c.variation_changes.select("id"), "id", "left_semi").filter(F.col("reference").isNotNull())
    assert new_refs.filter(F.length("reference") > 100).count() == 0
    dup = snap.filter(F.col("reference").isNotNull()).groupBy(F.upper("reference")).count().filter("count > 1")
    # only duplicates already present in the stored table may remain
    stored_dup = c.product_variations.filter(F.col("reference").isNotNull()).groupBy(F.upper("reference")).count() \
        .filter("count > 1")
    assert dup.count() == stored_dup.count()


def test_variation_changes_touch_only_changed_rows(spark):
    c = Catalogue(spark, SF_SMALL)
    v = c.product_variations
    snap = changes.apply_variation_changes(v, c.products, c.users, c.variation_changes).snapshot
    changed = c.variation_changes.select("id")
    before = v.join(changed, "id", "left_anti")
    after = snap.join(changed, "id", "left_anti").select(*v.columns)
    assert sorted(before.collect()) == sorted(after.collect())


def test_write_intake_keeps_products_and_defaults_together(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    root = str(tmp_path / "v2")
    changes.write_intake(c.product_intake, c, root)
    p2 = spark.read.parquet(f"{root}/products")
    v2 = spark.read.parquet(f"{root}/product_variations")
    rej = spark.read.parquet(f"{root}/rejected_intake")
    new_ids = p2.join(c.products.select("id"), "id", "left_anti")
    intake_n = c.product_intake.count()
    assert new_ids.count() + rej.count() == intake_n
    std = c.product_intake.filter((F.col("product_type") == "standard") & (F.col("seq") == 1)).select("id")
    # every accepted standard product has exactly one default variation, and no other new variation exists
    new_vars = v2.join(c.product_variations.select("id"), "id", "left_anti")
    assert new_vars.count() == new_ids.join(std, "id", "left_semi").count()
    assert new_vars.join(new_ids, new_vars.product_id == new_ids.id, "left_anti").count() == 0
    assert new_vars.filter(F.col("reference").isNull()).count() == 0


def test_envelope_write(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    env = listing.product_envelope(c.products, c.users, c.product_variations, 0, 5, "red")
    out = str(tmp_path / "env")
    env.write(out)
    counts = spark.read.json(f"{out}/counts").first()
    page = spark.read.json(f"{out}/data")
    assert counts.records_filtered <= counts.records_total
    assert page.count() == min(5, counts.records_filtered)


def test_batch_integrity_rules(spark):
    from vitrine.sources import schemas
    users = spark.createDataFrame([(1, "N", "P", "a@x.tn", "ROLE_ADMIN", None, False)], schemas.USERS)
    ch = spark.createDataFrame([
        (10, "N", "P", "same@x.tn", "ROLE_ADMIN", None, 1),
        (11, "N", "P", "SAME@x.tn", "ROLE_ADMIN", None, 1),
        (12, "", "P", "other@x.tn", "ROLE_ADMIN", None, 1),
        (13, "N", "P", "other@x.tn", "ROLE_ADMIN", None, 1),
        (14, "N", "P", "dup@x.tn", "ROLE_ADMIN", None, 1),
        (14, "N", "P", "dup2@x.tn", "ROLE_ADMIN", None, 2)], schemas.USER_CHANGES)
    res = changes.apply_user_changes(users, ch)
    rej_rows = [(r.id, r.reason) for r in res.rejected.collect()]
    rej = set(rej_rows)
    assert (11, "Cet email est déjà utilisé.") in rej          # 10 claimed it first
    assert (12, "Le nom est obligatoire.") in rej              # invalid row does not win the e-mail...
    assert not any(i == 13 for i, _ in rej)                    # ...so 13 gets it
    assert not any(i == 14 for i, _ in rej)                    # both changes of 14 are applied, one after the other
    snap = {r.id: r.email for r in res.snapshot.collect()}
    assert snap == {1: "a@x.tn", 10: "same@x.tn", 13: "other@x.tn", 14: "dup2@x.tn"}
