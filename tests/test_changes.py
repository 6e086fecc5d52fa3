"""Change jobs on hand-made rows: nothing is lost, nothing is written that a rule forbids."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions.text import like_text
from vitrine.operators import changes, filters, listing, quality, references
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources import schemas, snapshots

ADMIN, OWNER, OTHER, GONE = 1, 3, 4, 5
KEY = "a" * 32


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([
        (ADMIN, "N", "P", "a@x.tn", "ROLE_ADMIN", None, False), (OWNER, "N", "P", "o@x.tn", "ROLE_FOURNISSEUR", "T", False),
        (OTHER, "N", "P", "b@x.tn", "ROLE_FOURNISSEUR", "T", False),
        (GONE, "N", "P", "g@x.tn", "ROLE_FOURNISSEUR", "T", True)], schemas.USERS)
    products = spark.createDataFrame([
        (5, "Chaise", "D", f"{OWNER}/{KEY}.png", Decimal("9.000"), OWNER, False),
        (6, "Table", "D", None, Decimal("8.000"), OTHER, True), (7, "Lampe", "D", None, Decimal("8.000"), OTHER, False)],
        schemas.PRODUCTS)
    variations = spark.createDataFrame([
        (i, 5, "Rouge", '{"c":"r"}', Decimal("0"), 10, 0, f"PRD-000005-V{i}", False) for i in range(1, 8)]
        + [(20, 6, "X", "[]", Decimal("0"), 1, 0, None, False), (21, 7, "X", "[]", Decimal("0"), 4, 0, None, False)],
        schemas.VARIATIONS)
    return users, products, variations


class Stored:
    """A catalogue given by its tables."""

    def __init__(self, spark, users, products, product_variations):
        self.spark, self.users, self.products, self.product_variations = spark, users, products, product_variations


def reasons(df):
    return sorted((r["id"], r["reason"]) for r in df.collect())


def test_intake(spark, tables, tmp_path):
    users, products, variations = tables

    def row(i, prix="10", actor=ADMIN, image=None, seq=1, kind="standard", supplier=OWNER):
        return (i, f"L{i}", "D", prix, kind, "2", supplier, actor, image, seq)
    rows = spark.createDataFrame([
        row(5), row(6), row(10, "12345678.123"), row(11), row(12, actor=OTHER), row(13, actor=GONE), row(14, actor=99),
        row(15, image=f"{OWNER}/{KEY}.webp"), row(16, image="../../etc/x.php"), row(17, image=f"{OTHER}/{KEY}.png"),
        row(18, "x"), row(18, "2", seq=2), row(18, "3", seq=3), row(19, kind="variations"), row(20, supplier=GONE),
        row(21, "9999999.999"), row(22, "10000000")], schemas.PRODUCT_INTAKE)
    new, defaults, rejected = changes.intake(rows, users, products)
    got = {r["id"]: r for r in new.collect()}
    assert set(got) == {11, 12, 15, 18, 19, 21}
    assert got[12]["fournisseur_id"] == OTHER and got[11]["fournisseur_id"] == OWNER
    assert got[15]["image"] == f"{OWNER}/{KEY}.webp" and got[18]["prix"] == Decimal("2.000")
    assert got[21]["prix"] == Decimal("9999999.999")
    M = quality.MSG
    assert reasons(rejected) == sorted([
        (5, M["product_stored"]), (6, M["product_stored"]), (10, M["price_range"]), (13, M["add_denied"]),
        (14, M["add_denied"]), (16, M["image_invalid"]), (17, M["image_invalid"]), (18, M["price_pattern"]),
        (18, M["product_stored"]), (20, M["supplier_invalid"]), (22, M["price_range"])])
    changes.write_intake(rows, Stored(spark, *tables), str(tmp_path / "next"))
    for table in ("products", "product_variations"):
        stored = spark.read.parquet(str(tmp_path / "next" / table))
        assert stored.count() == stored.select("id").distinct().count()
    assert {r["id"] - changes.DEFAULT_VARIATION_START for r in defaults.collect()} == {11, 12, 15, 18, 21}
    # an id that a default variation would get is stored already
    taken = variations.unionByName(variations.limit(1).withColumn("id", F.lit(changes.DEFAULT_VARIATION_START + 11)))
    new, defaults, rejected = changes.intake(rows, users, products, taken)
    assert {r["id"] for r in new.collect()} == {12, 15, 18, 19, 21} and (11, M["product_stored"]) in reasons(rejected)
    assert 11 + changes.DEFAULT_VARIATION_START not in {r["id"] for r in defaults.collect()}


def test_product_updates(spark, tables):
    users, products, _ = tables

    def row(i, prix="4", actor=OWNER, image=None, remove=False, seq=1, supplier=OWNER):
        return (i, "Neuf", "D", prix, supplier, remove, image, actor, seq)
    rows = [row(5, "12345678.123"), row(7, actor=OWNER), row(8), row(6, actor=OTHER, image="../../etc/x.php")]
    res = changes.apply_product_updates(products, users, spark.createDataFrame(rows, schemas.PRODUCT_UPDATES))
    assert reasons(res.rejected) == sorted([(5, quality.MSG["price_range"]), (7, changes.EDIT_DENIED),
                                            (8, changes.PRODUCT_NOT_FOUND), (6, quality.MSG["image_invalid"])])
    assert sorted(res.snapshot.collect()) == sorted(products.collect())
    rows = [row(5, "1"), row(5, "2", image=f"{OWNER}/{'b' * 32}.png", seq=2)]
    res = changes.apply_product_updates(products, users, spark.createDataFrame(rows, schemas.PRODUCT_UPDATES))
    assert reasons(res.rejected) == []
    assert {r["id"]: r["prix"] for r in res.snapshot.collect()}[5] == Decimal("2.000")
    assert [(r["id"], r["image"]) for r in changes.replaced_image_keys(res).collect()] == [(5, f"{OWNER}/{KEY}.png")]


def test_variation_changes(spark, tables):
    users, products, variations = tables

    def row(i, attributs='{"t":"M"}', prix="1", actor=ADMIN, seq=1, product=5):
        return (i, product, "", attributs, prix, "3", actor, seq)
    rows = [row(1, "not json"), row(2, '{"a":" "}'), row(3, None), row(4, prix="99999999"), row(5, actor=OTHER),
            row(6, actor=GONE), row(7), row(7, "[1]", seq=2), row(30, actor=OWNER), row(31, product=6),
            row(changes.DEFAULT_VARIATION_START + 8)]
    res = changes.apply_variation_changes(variations, products, users, spark.createDataFrame(rows, schemas.VARIATION_CHANGES))
    M = quality.MSG
    assert reasons(res.rejected) == sorted([
        (changes.DEFAULT_VARIATION_START + 8, changes.RESERVED_ID), (1, M["attributes_invalid"]), (4, M["supplement_range"]), (5, changes.VARIATION_DENIED),
        (6, changes.ACCOUNT_DISABLED), (7, M["attributes_invalid"]), (31, changes.PRODUCT_NOT_FOUND)])
    got = {r["id"]: r for r in res.snapshot.collect()}
    assert got[1]["attributs"] == '{"c":"r"}' and got[2]["attributs"] == "[]" and got[3]["attributs"] == "[]"
    assert got[4]["prix_supplement"] == Decimal("0.000") and got[30]["attributs"] == '{"t":"M"}'
    assert got[7]["attributs"] == '{"t":"M"}'  # the refused second change takes nothing from the first
    assert got[30]["reference"] and len(got) == variations.count() + 1


def test_deletes(spark, tables):
    users, products, variations = tables
    asked = spark.createDataFrame([(5, OWNER), (7, OWNER), (6, OTHER), (99, ADMIN), (7, GONE)], schemas.DELETES)
    res = changes.apply_product_deletes(products, users, asked)
    assert reasons(res.rejected) == sorted([(7, changes.DELETE_DENIED), (99, changes.PRODUCT_NOT_FOUND),
                                            (7, changes.ACCOUNT_DISABLED)])
    assert {r["id"]: r["is_deleted"] for r in res.snapshot.collect()} == {5: True, 6: True, 7: False}
    asked = spark.createDataFrame([(1, OWNER), (2, OTHER), (20, ADMIN), (77, ADMIN), (21, OTHER)], schemas.DELETES)
    res = changes.apply_variation_deletes(variations, products, users, asked)
    assert reasons(res.rejected) == sorted([(2, changes.VARIATION_DENIED), (20, changes.PRODUCT_NOT_FOUND),
                                            (77, changes.VARIATION_NOT_FOUND)])
    stock = changes.stock_after_deletes(variations, products, users, asked)
    assert sorted(map(tuple, stock.collect())) == [(5, 60), (7, 0)]
    res = changes.apply_user_deletes(users, spark.createDataFrame([(3,), (3,), (44,)], schemas.IDS))
    assert reasons(res.rejected) == [(44, "user_not_found")]


def test_search_with_a_backslash(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "ab"), (3, "a%b"), (4, "a\\")], "id int, libelle string")

    def found(term):
        return sorted(r["id"] for r in filters.search(df, ["libelle"], term).collect())
    assert found("a\\b") == [1] and found("a\\") == [1, 4] and found("a\\%b") == [3] and found("a%b") == [1, 2, 3]
    assert like_text("x_y") == "x_y"


def test_null_attribute_value_is_shown(spark):
    df = spark.createDataFrame([('{"a":null,"b":"x"}',), ("[]",)], "attributs string")
    assert [r[0] for r in df.select(attrs.attribute_text(df["attributs"])).collect()] == ["a : , b : x", "Standard"]


def test_half_written_root_is_no_catalogue(spark, tmp_path, tables):
    users, products, variations = tables
    root = str(tmp_path / "root")
    products.write.parquet(f"{root}/products")
    assert not snapshots.is_snapshot_root(spark, root)
    snapshots.publish(spark, root)
    assert snapshots.is_snapshot_root(spark, root)


def test_cluster_without_checkpoint_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_product_page_matches_a_plain_join(spark, tables):
    users, products, variations = tables
    for search in (None, "cha"):
        page = listing.product_page(products, users, variations, 0, 5, search).collect()
        assert [(r["id"], r["stock"]) for r in page] == ([(7, 4), (5, 70)] if search is None else [(5, 70)])
    assert references.assign_references(variations).count() == 2
