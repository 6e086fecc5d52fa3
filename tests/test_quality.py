"""Data-quality rules on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from vitrine.operators import quality
from vitrine.sources import assets, schemas


def _users(spark, emails):
    return spark.createDataFrame([(i + 1, "N", "P", e, "ROLE_ADMIN", None, False) for i, e in enumerate(emails)],
                                 schemas.USERS)


def test_dq12_duplicates_ignore_case_accents_and_trailing_spaces(spark):
    u = _users(spark, ["ana@x.tn", "ANA@x.tn  ", "ána@x.tn", "bob@x.tn", "bob@x.tn.fr"])
    got = {(r.id, r.n_same) for r in quality.duplicate_emails(u).collect()}
    assert got == {(1, 3), (2, 3), (3, 3)}


def test_dq9_email_pattern(spark):
    ch = spark.createDataFrame([(1, "N", "P", e, "ROLE_ADMIN", None, 1) for e in
                                ["a@b.tn", "a@b", "a b@c.tn", "", "x.y+z@sub.example.com"]], schemas.USER_CHANGES)
    ch = ch.withColumn("id", F.monotonically_increasing_id() + 10)
    out = {r.email: r.first_message for r in
           quality.validate_user_rows(ch, _users(spark, ["zz@x.tn"])).collect()}
    assert out["a@b.tn"] is None and out["x.y+z@sub.example.com"] is None
    assert out["a@b"] == quality.MSG["email_invalid"]
    assert out["a b@c.tn"] == quality.MSG["email_invalid"]
    assert out[""] == quality.MSG["email_blank"]


def test_dq21_dq22_image_keys(spark):
    good = "3/" + "a" * 32 + ".png"
    rows = [(1, good, 3), (2, good, 4), (3, "7/../p1.gif", 7), (4, "/etc/passwd", 1), (5, None, 1)]
    p = spark.createDataFrame([(i, "l", "d", img, Decimal("1"), f, False) for i, img, f in rows], schemas.PRODUCTS)
    got = {r.id: r.status for r in assets.audit_image_keys(p).collect()}
    assert got == {1: "ok", 2: "warning", 3: "error", 4: "error"}


def test_dq14_dq15_intake_order(spark):
    users = spark.createDataFrame([(3, "N", "P", "s@x.tn", "ROLE_FOURNISSEUR", "T", False),
                                   (1, "N", "P", "a@x.tn", "ROLE_ADMIN", None, False)], schemas.USERS)
    intake = spark.createDataFrame([
        (1, "Chaise", "D", "10", "bundle", "5", 3, 1, None, 1),
        (2, "Chaise", "D", "10", "standard", "-1", 3, 1, None, 1),
        (3, "Chaise", "D", "10", "variations", "-1", 3, 1, None, 1),
        (4, " ", "D", "1.2345", "standard", "2", 3, 1, None, 1),
        (5, "Chaise", "D", "12,5", "standard", "2", 9, 1, None, 1),
        (6, "Chaise", "D", "12,5", "standard", " 2 ", 3, 3, None, 1)], schemas.PRODUCT_INTAKE)
    out = {r.id: r.first_message for r in quality.validate_intake(intake, users, spark.createDataFrame([], schemas.PRODUCTS)).collect()}
    assert out[1] == quality.MSG["type_invalid"]
    assert out[2] == quality.MSG["stock_negative"]
    assert out[3] is None                      # negative stock only matters for standard products
    assert out[4] == quality.MSG["product_label_blank"]
    assert out[5] == quality.MSG["supplier_invalid"]
    assert out[6] is None
