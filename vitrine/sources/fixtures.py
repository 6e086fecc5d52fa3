"""Catalogue tables derived from the driver's TPC-H-ish tables.

The reference ships no data. These views fill its three tables (plus the change
sets of the batch jobs) from ``supplier``, ``nation``, ``region``, ``part``,
``orders`` and ``events``; the same views exist as SQL in
``vitrine.plans.views_sql`` for the DuckDB cross-check. Every view is a plain
projection or a join against the tiny ``nation``/``region`` tables, so its size
grows with the source table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources import schemas
from vitrine.sources.tables import raw

_STR = "string"
# Ids of new rows and of rows that do not exist lie far above any source key.
NEW_ID = 1 << 40
NEW_VARIATION_ID = 1 << 41
NO_ID = 1 << 43
ADMIN = 1000002


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = raw(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = raw(spark, sf_dir, "region", "r_regionkey", "r_name")
    suppliers = (s.join(n, s.s_nationkey == n.n_nationkey)
                 .join(r, n.n_regionkey == r.r_regionkey)
                 .select((F.col("s_suppkey").cast("bigint") + 1).alias("id"),
                         F.col("n_name").alias("nom"),
                         F.col("s_name").alias("prenom"),
                         F.concat(F.lit("s"), F.col("s_suppkey").cast(_STR), F.lit("@example.com")).alias("email"),
                         F.lit("ROLE_FOURNISSEUR").alias("role"),
                         F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast(_STR))
                          .otherwise(F.col("r_name")).alias("libelle"),
                         (F.col("s_suppkey") % 5 == 4).alias("is_deleted")))
    admins = raw(spark, sf_dir, "nation", "n_nationkey", "n_name").select(
        (F.col("n_nationkey").cast("bigint") + 1000001).alias("id"),
        F.col("n_name").alias("nom"),
        F.lit("Admin").alias("prenom"),
        F.when(F.col("n_nationkey") == 3, F.lit("S3@EXAMPLE.COM"))
         .otherwise(F.concat(F.lit("n"), F.col("n_nationkey").cast(_STR), F.lit("@example.com"))).alias("email"),
        F.lit("ROLE_ADMIN").alias("role"),
        F.lit(None).cast(_STR).alias("libelle"),
        (F.col("n_nationkey") % 5 == 0).alias("is_deleted"))
    return _conform(suppliers.unionByName(admins), schemas.USERS)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    key = F.col("p_partkey")
    md5 = F.md5(key.cast(_STR))
    image = (F.when(key % 4 == 0, F.lit(None).cast(_STR))
             .when(key % 4 == 1, F.concat(F.lit("uploads/products/"), (key % 10 + 1).cast(_STR), F.lit("/"), md5, F.lit(".jpg")))
             .when(key % 4 == 2, F.concat(F.lit("7/../p"), key.cast(_STR), F.lit(".gif")))
             .otherwise(F.concat((key % 10 + 1).cast(_STR), F.lit("/"), md5, F.lit(".png"))))
    deleted = (F.when(key % 11 == 0, F.lit(None).cast("boolean"))
               .when(key % 11 == 1, F.lit(True)).otherwise(F.lit(False)))
    df = p.select((key.cast("bigint") + 1).alias("id"),
                  F.col("p_name").alias("libelle"),
                  F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("description"),
                  image.alias("image"),
                  F.col("p_retailprice").cast(schemas.PRICE).alias("prix"),
                  ((key % 10).cast("bigint") + 1).alias("fournisseur_id"),
                  deleted.alias("is_deleted"))
    return _conform(df, schemas.PRODUCTS)


def product_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ok, ck, prio = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    df = o.select(
        (ok.cast("bigint") + 1).alias("id"),
        (F.when(ok % 500 == 7, F.lit(NO_ID)).otherwise(ck).cast("bigint") + 1).alias("product_id"),
        prio.alias("libelle"),
        F.when(ok % 4 == 0, F.lit("[]"))
         .otherwise(F.concat(F.lit('{"Priorite":"'), prio, F.lit('"}'))).alias("attributs"),
        F.when(ck % 2 == 0, F.lit(0)).otherwise((ok % 4) * 0.5).cast(schemas.PRICE).alias("prix_supplement"),
        (F.floor(F.col("o_totalprice")).cast("bigint") % 50).alias("stock"),
        F.lit(0).cast("bigint").alias("stock_utilise"),
        F.when(ok % 10 == 0, F.lit(None).cast(_STR))
         .otherwise(F.concat(F.lit("PRD-"), F.lpad((ck + 1).cast(_STR), 6, "0"), F.lit("-"),
                             F.upper(F.replace(prio, F.lit(" "), F.lit("-"))))).alias("reference"),
        (F.col("o_orderstatus") == "F").alias("is_deleted"))
    return _conform(df, schemas.VARIATIONS)


def product_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    key = F.col("p_partkey")
    libelle = (F.when(key % 7 == 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")))
               .when(key % 7 == 1, F.lit("   ")).otherwise(F.col("p_name")))
    prix = (F.when(key % 8 == 0, F.lit(" 12,5 ")).when(key % 8 == 1, F.lit("1.2345"))
            .when(key % 8 == 2, F.lit("")).when(key % 8 == 3, F.lit("-3"))
            .when(key % 16 == 12, F.lit("12345678.123")).when(key % 8 == 4, F.lit("abc"))
            .otherwise(F.col("p_retailprice").cast(schemas.PRICE).cast(_STR)))
    ptype = (F.when(key % 5 == 0, F.lit("standard")).when(key % 5 == 1, F.lit("bundle"))
             .when(key % 5 == 2, F.lit("variations")).otherwise(F.lit("standard")))
    stock = (F.when(key % 6 == 5, F.lit("-1")).when(key % 6 == 4, F.lit("x"))
             .otherwise(F.col("p_size").cast(_STR)))
    owner = F.when(key % 4 == 0, key % 10 + 1).otherwise(key % 12).cast("bigint")
    image = (F.when(key % 6 == 0, F.concat(owner.cast(_STR), F.lit("/"), F.md5(key.cast(_STR)), F.lit(".png")))
             .when(key % 6 == 1, F.lit("../../etc/x.php")))
    first = p.select(F.when(key % 9 == 4, key.cast("bigint") + 1).otherwise(key.cast("bigint") + NEW_ID).alias("id"),
                     libelle.alias("libelle"), F.col("p_type").alias("description"), prix.alias("prix"),
                     ptype.alias("product_type"), stock.alias("stock"),
                     (key % 12).cast("bigint").alias("fournisseur_id"),
                     F.when(key % 4 == 0, key % 10 + 1).when(key % 20 == 1, F.lit(NO_ID)).otherwise(F.lit(ADMIN))
                      .cast("bigint").alias("actor_id"),
                     image.alias("image"), F.lit(1).cast("bigint").alias("seq"))
    second = (first.filter(F.col("id") % 25 == 0)
              .withColumn("libelle", F.lit("Second")).withColumn("prix", F.lit("5")).withColumn("seq", F.lit(2)))
    third = first.filter(F.col("id") % 6 == 0).withColumn("prix", F.lit("abc")).withColumn("seq", F.lit(3))
    return _conform(first.unionByName(second).unionByName(third), schemas.PRODUCT_INTAKE)


def product_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    p = raw(spark, sf_dir, "part", "p_partkey").filter(key % 13 == 0)
    return _conform(p.select(
        F.when(key % 39 == 0, key.cast("bigint") + NEW_ID).otherwise(key.cast("bigint") + 1).alias("id"),
        F.when(key % 3 == 1, F.lit(ADMIN)).when(key % 7 == 0, (key + 1) % 10 + 1).otherwise(key % 10 + 1)
         .cast("bigint").alias("actor_id")), schemas.DELETES)


def variation_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    o = raw(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter(ok % 17 == 0)
    return _conform(o.select(
        F.when(ok % 51 == 0, ok.cast("bigint") + NEW_VARIATION_ID).otherwise(ok.cast("bigint") + 1).alias("id"),
        F.when(ok % 2 == 0, F.lit(ADMIN)).when(ok % 5 == 0, (ck + 1) % 10 + 1).otherwise(ck % 10 + 1)
         .cast("bigint").alias("actor_id")), schemas.DELETES)


def user_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    s = raw(spark, sf_dir, "supplier", "s_suppkey").filter(key % 4 == 1)
    return s.select((key.cast("bigint") + F.when(key % 8 == 5, F.lit(NEW_ID)).otherwise(F.lit(1))).alias("id"))


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events", "event_id", "user_id")
    return e.select(
        F.col("event_id"),
        F.when(F.col("event_id") % 9 == 0, F.lit(ADMIN).cast("bigint"))
         .when(F.col("event_id") % 17 == 0, F.lit(NO_ID))
         .otherwise((F.col("user_id") % 12).cast("bigint") + 1).alias("user_id"),
        F.when(F.col("event_id") % 13 == 0, F.lit(NO_ID))
         .otherwise((F.col("event_id") % 200).cast("bigint") + 1).alias("product_id"))


def product_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    key = F.col("p_partkey")
    owner = F.when(key % 3 == 0, key % 12).otherwise(key % 10 + 1).cast("bigint")
    first = p.filter(key % 7 == 0).select(
        (key.cast("bigint") + 1).alias("id"),
        F.upper(F.col("p_name")).alias("libelle"),
        F.col("p_type").alias("description"),
        F.when(key % 28 == 0, F.lit("12345678.123")).when(key % 2 == 0, F.lit("19,900")).otherwise(F.lit("7.5")).alias("prix"),
        (key % 12).cast("bigint").alias("fournisseur_id"),
        (key % 4 == 1).alias("remove_image"),
        F.when(key % 5 == 0, F.concat(owner.cast(_STR), F.lit("/"), F.md5(F.concat(F.lit("n"), key.cast(_STR))), F.lit(".webp")))
         .when(key % 5 == 1, F.lit("../../etc/x.php")).alias("new_image"),
        F.when(key % 3 == 0, F.lit(ADMIN).cast("bigint"))
         .otherwise((key % 10).cast("bigint") + 1).alias("actor_id"),
        F.lit(1).cast("bigint").alias("seq"))
    second = (first.filter(F.col("id") % 11 == 0)
              .withColumn("libelle", F.lit("Second")).withColumn("prix", F.lit("8")).withColumn("seq", F.lit(2)))
    # asked by the supplier that the first change names: allowed only where an admin has moved the product there
    third = (first.filter(F.col("id") % 2 == 0).withColumn("libelle", F.lit("Third")).withColumn("prix", F.lit("3"))
             .withColumn("actor_id", (F.col("id") - 1) % 12).withColumn("new_image", F.lit(None).cast(_STR))
             .withColumn("seq", F.lit(3)))
    return _conform(first.unionByName(second).unionByName(third), schemas.PRODUCT_UPDATES)


def variation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posted form for every variation: an edit of a stored one, or a new one."""
    o = raw(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    df = o.select(
        F.when(ok % 40 == 1, ok.cast("bigint") + NEW_VARIATION_ID).otherwise(ok.cast("bigint") + 1).alias("id"),
        (ck.cast("bigint") + 1).alias("product_id"),
        F.when(ok % 3 == 0, F.lit("")).otherwise(F.lit(" Lot A ")).alias("libelle"),
        F.when(ok % 11 == 3, F.lit("not json")).when(ok % 11 == 4, F.lit('{"a":" ","b":""}'))
         .when(ok % 11 == 5, F.lit(None).cast(_STR)).when(ok % 2 == 0, F.lit("[]"))
         .otherwise(F.lit('{"Couleur":"Rouge","Taille":"M"}')).alias("attributs"),
        F.when(ok % 13 == 2, F.lit("99999999")).otherwise(F.lit("2,5")).alias("prix_supplement"),
        (ok % 30).cast(_STR).alias("stock"),
        F.when(ok % 7 == 0, (ck + 1) % 10 + 1).when(ok % 3 == 1, ck % 10 + 1).otherwise(F.lit(ADMIN))
         .cast("bigint").alias("actor_id"),
        F.lit(1).cast("bigint").alias("seq"), ok.alias("ok"))
    return df


def variation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = variation_forms(spark, sf_dir)
    first = forms.filter((F.col("ok") % 40).isin(0, 1))
    second = (first.filter(F.col("ok") % 120 == 0)
              .withColumn("libelle", F.lit(" Lot B ")).withColumn("seq", F.lit(2)))
    # of new rows the third names another product, which counts only where no change before it was accepted
    third = (first.filter(F.col("ok") % 3 == 1).withColumn("libelle", F.lit(" Lot C ")).withColumn("prix_supplement", F.lit("1"))
             .withColumn("product_id", F.col("product_id") + 1)
             .withColumn("actor_id", F.when(F.col("ok") % 2 == 0, F.col("product_id") % 10 + 1).otherwise(F.lit(ADMIN)))
             .withColumn("seq", F.lit(3)))
    return _conform(first.unionByName(second).unionByName(third), schemas.VARIATION_CHANGES)


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    key = F.col("s_suppkey")
    first = s.select(
        F.when(key % 2 == 0, key.cast("bigint") + 1).otherwise(key.cast("bigint") + NEW_ID).alias("id"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("nom"),
        F.lit("Prenom").alias("prenom"),
        F.concat(F.lit("c"), key.cast(_STR), F.lit("@example.com")).alias("email"),
        F.when(key % 5 == 0, F.lit("ROLE_ADMIN")).when(key % 5 == 1, F.lit("ROLE_OTHER"))
         .otherwise(F.lit("ROLE_FOURNISSEUR")).alias("role"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.lit("Maison")).alias("libelle"),
        F.lit(1).cast("bigint").alias("seq"))
    second = first.filter(F.col("id") % 6 == 1).withColumn("nom", F.lit("Second")).withColumn("seq", F.lit(2))

    def takes(every: int, extra: int, mail: str, seq: int) -> DataFrame:
        return s.filter(key % every == 0).select(
            (key.cast("bigint") + NEW_ID + extra).alias("id"), F.lit("Reprise").alias("nom"), F.lit("P").alias("prenom"),
            F.concat(F.lit(mail), key.cast(_STR), F.lit("@example.com")).alias("email"), F.lit("ROLE_ADMIN").alias("role"),
            F.lit(None).cast(_STR).alias("libelle"), F.lit(seq).cast("bigint").alias("seq"))
    # addresses that the first changes free: taken, asked for again, left, and taken by a third account
    handed = [takes(4, 500_000, "S", 3), takes(8, 700_000, "s", 4), takes(4, 500_000, "m", 5), takes(16, 700_000, "s", 6)]
    out = first.unionByName(second)
    for df in handed:
        out = out.unionByName(df)
    return _conform(out, schemas.USER_CHANGES)


def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier", "s_suppkey")
    key = F.col("s_suppkey")
    return s.select(
        F.when(key % 2 == 0, key.cast("bigint") + 1).otherwise(F.lit(None).cast("bigint")).alias("id"),
        F.when(key % 3 == 0, F.concat(F.lit("free"), key.cast(_STR), F.lit("@example.com")))
         .otherwise(F.concat(F.lit("S"), key.cast(_STR), F.lit("@Example.com"))).alias("email"))


def image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part", "p_partkey")
    key = F.col("p_partkey")
    return p.select(
        F.concat((key % 10 + 1).cast(_STR), F.lit("/"), F.md5(key.cast(_STR)),
                 F.when(key % 4 == 3, F.lit(".png")).otherwise(F.lit(".jpg"))).alias("image_key"),
        (key.cast("bigint") * 40000).alias("length"),
        F.when(key % 6 == 0, F.lit("image/gif")).when(key % 6 == 1, F.lit("image/png"))
         .when(key % 6 == 2, F.lit("image/webp")).otherwise(F.lit("image/jpeg")).alias("mime"))


VIEWS = {
    "users": users,
    "products": products,
    "product_variations": product_variations,
    "product_intake": product_intake,
    "product_deletes": product_deletes,
    "variation_deletes": variation_deletes,
    "user_deletes": user_deletes,
    "access_requests": access_requests,
    "product_updates": product_updates,
    "variation_forms": variation_forms,
    "variation_changes": variation_changes,
    "user_changes": user_changes,
    "email_candidates": email_candidates,
    "image_assets": image_assets,
}


class Catalogue:
    """The catalogue tables and change sets of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return VIEWS[name](self.spark, self.sf_dir)
        raise AttributeError(name)
