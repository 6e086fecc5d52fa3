"""Physical plans have the shape the design relies on."""

from pyspark.sql import functions as F

from vitrine.operators import filters, listing
from vitrine.plans import QUERIES
from vitrine.sources import schemas, snapshots
from vitrine.sources.fixtures import Catalogue
from vitrine.sources.tables import read_snapshot, write_snapshot

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "products")
    write_snapshot(Catalogue(spark, SF_SMALL).products, path)
    df = filters.active_strict(read_snapshot(spark, path, schemas.PRODUCTS)).select("id", "libelle")
    plan = _plan(df)
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "IsNotNull(is_deleted)" in pushed and "EqualTo(is_deleted," in pushed
    assert "ReadSchema: struct<id:bigint,libelle:string,is_deleted:boolean>" in plan


def test_page_reduces_users_and_variations_first(spark, tmp_path, monkeypatch):
    """The page comes from the products alone; users and variations only meet an exchange
    after the semi join with the page's keys."""
    root = str(tmp_path / "snap")
    snapshots.export(Catalogue(spark, SF_SMALL), root)
    first: list[str] = []
    keep = listing.materialise
    monkeypatch.setattr(listing, "materialise", lambda df: (first.append(_plan(df)), keep(df))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")
    try:
        plan = _plan(QUERIES["product_page"].build(spark, root))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(first) == 1 and "TakeOrderedAndProject" in first[0] and "Join" not in first[0]
    lines = plan.splitlines()
    for column in ("prenom", "prix_supplement"):  # of the users, of the variations
        at = next(i for i, x in enumerate(lines) if "FileScan" in x and column in x)
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
        above = []
        for x in reversed(lines[:at]):
            d = len(x) - len(x.lstrip(" :+-*()0123456789"))
            if d < depth:
                above.append(x)
                depth = d
        semi = next(i for i, x in enumerate(above) if "LeftSemi" in x)
        assert not any("Exchange hashpartitioning" in x for x in above[:semi]), plan


def test_counter_reads_only_products_with_new_rows(spark, monkeypatch):
    from vitrine.operators import changes, references
    c = Catalogue(spark, SF_SMALL)
    sizes = []
    keep = references.materialise
    monkeypatch.setattr(references, "materialise", lambda df: (sizes.append(df.count()), keep(df))[1])
    few = c.variation_changes.filter("product_id <= 5")
    changes.apply_variation_changes(c.product_variations, c.products, c.users, few)
    near = c.product_variations.filter("product_id <= 5").count() + few.count()
    assert max(sizes) <= near < c.product_variations.count() / 4


def test_group_numbering_is_not_one_window_per_supplier(spark):
    plan = _plan(QUERIES["supplier_pages"].build(spark, SF_SMALL))
    assert "__bucket" in plan and "Window" in plan


def test_mart_write_partitions_by_supplier(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    mart = listing.catalogue_mart(c.products, c.users, c.product_variations)
    out = str(tmp_path / "mart")
    listing.write_catalogue_mart(mart, out)
    back = spark.read.parquet(out)
    assert back.count() == mart.count()
    assert back.select("fournisseur_id").distinct().count() == mart.select("fournisseur_id").distinct().count()
    assert back.filter(F.col("fournisseur_id") == 3).count() == mart.filter(F.col("fournisseur_id") == 3).count()
