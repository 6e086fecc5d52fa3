"""Operators rewritten for hot keys give the same rows as their plain forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import quality, relations
from vitrine.sources import schemas


def test_email_usage_with_a_hot_address(spark):
    users = spark.createDataFrame(
        [(i, "n", "p", "hot@example.com" if i <= 300 else f"u{i}@example.com", "ROLE_ADMIN", None, False)
         for i in range(1, 400)], schemas.USERS)
    cands = spark.createDataFrame(
        [(5, "HOT@example.com "), (None, "hot@example.com"), (999, "free@example.com"),
         (350, "u350@example.com"), (351, "U350@EXAMPLE.COM")], "id long, email string")
    got = {(r.id, r.email): r.email_taken for r in quality.email_usage(cands, users).collect()}
    assert got == {(5, "HOT@example.com "): True, (None, "hot@example.com"): True,
                   (999, "free@example.com"): False, (350, "u350@example.com"): False,
                   (351, "U350@EXAMPLE.COM"): True}


def test_products_with_variations_hot_product(spark):
    products = spark.createDataFrame(
        [(i, f"p{i}", "d", None, None, 1, i == 3) for i in range(1, 6)], schemas.PRODUCTS)
    rows = [(i, 1 if i % 3 else 2, "v", "[]", None, i, 0, None, i % 7 == 0) for i in range(1, 2000)]
    rows.append((5000, 99, "orphan", "[]", None, 1, 0, None, False))
    variations = spark.createDataFrame(rows, schemas.VARIATIONS)
    got = relations.products_with_variations(products, variations)
    w = Window.partitionBy("product_id").orderBy("id")
    v = variations.withColumn("position", F.row_number().over(w).cast("bigint"))
    p = products.select(F.col("id").alias("product_id"), F.col("libelle").alias("product_libelle"),
                        F.col("is_deleted").alias("product_is_deleted"))
    want = p.join(v.select("product_id", F.col("id").alias("variation_id"), "position",
                           *[F.col(c).alias("v_" + c) for c in relations.VARIATION_COLUMNS]), "product_id", "left")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    assert got.filter(F.col("variation_id").isNull()).count() == 3
