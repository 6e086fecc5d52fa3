"""Queries give the same rows on stored snapshots as on the derived views."""

from vitrine import cli
from vitrine.operators import changes
from vitrine.plans import QUERIES
from vitrine.sources import snapshots
from vitrine.sources.fixtures import Catalogue

from conftest import SF_SMALL

SAMPLE = ["product_page", "catalogue_mart", "assign_references", "apply_variation_changes", "dq_intake",
          "apply_product_updates", "access_matrix", "email_availability", "orphan_images", "supplier_pages"]


def test_queries_on_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    snapshots.export(Catalogue(spark, SF_SMALL), root)
    assert snapshots.is_snapshot_root(spark, root)
    for name in SAMPLE:
        a = sorted(QUERIES[name].build(spark, SF_SMALL).collect(), key=repr)
        b = sorted(QUERIES[name].build(spark, root).collect(), key=repr)
        assert a == b, name


def test_cli_run_writes_new_directory(spark, tmp_path):
    out = str(tmp_path / "page")
    assert cli.main(["run", "product_page", "--tables", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(out).count() == QUERIES["product_page"].build(spark, SF_SMALL).count()


def test_every_query_runs_on_the_next_versions(spark, tmp_path):
    """Intake, then updates, on stored tables: each version is a whole catalogue, and refers to what it did not change."""
    first, second, third = (str(tmp_path / n) for n in ("first", "second", "third"))
    snapshots.export(Catalogue(spark, SF_SMALL), first)
    c = snapshots.SnapshotCatalogue(spark, first)
    changes.write_intake(c.product_intake, c, second)
    c = snapshots.SnapshotCatalogue(spark, second)
    updates = changes.apply_product_updates(c.products, c.users, c.product_updates)
    changes.write_change_result(updates, "products", c, third)
    last = snapshots.SnapshotCatalogue(spark, third)
    assert last.folder("products").startswith(third)
    assert last.folder("product_variations").startswith(second) and last.folder("users").startswith(first)
    assert sorted(last.products.collect()) == sorted(updates.snapshot.collect())
    for name, q in QUERIES.items():
        if name != "evolve_prices":  # reads the old price column of the source table
            for root in (second, third):
                q.build(spark, root).limit(1).collect()


def test_a_version_of_derived_views_has_all_tables(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    root = str(tmp_path / "next")
    changes.write_change_result(changes.apply_user_deletes(c.users, c.user_deletes), "users", c, root)
    stored = snapshots.SnapshotCatalogue(spark, root)
    assert stored.products.count() == c.products.count() and stored.product_variations.count() == c.product_variations.count()
    assert stored.users.filter("is_deleted").count() > c.users.filter("is_deleted").count()
