"""One test per semantic trap and per scalar rule, on hand-made rows."""

from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from vitrine.functions import attributes as attrs
from vitrine.functions import images, prices
from vitrine.functions import references as refs
from vitrine.functions.text import falsy_default, php_concat, php_trim
from vitrine.operators import filters, listing, summary
from vitrine.sources import schemas


def _products(spark, rows):
    return spark.createDataFrame(rows, schemas.PRODUCTS)


def test_t1_strict_and_lenient(spark):
    p = _products(spark, [(1, "a", "d", None, Decimal("1.000"), 1, None),
                          (2, "b", "d", None, Decimal("1.000"), 1, True),
                          (3, "c", "d", None, Decimal("1.000"), 1, False)])
    assert sorted(r.id for r in filters.active_strict(p).collect()) == [3]
    assert sorted(r.id for r in filters.active_lenient(p).collect()) == [1, 3]


def test_t2_t3_search_modes(spark):
    df = spark.createDataFrame([("Éclair",), ("abc",), ("a_c",)], "t string")
    like = filters.search(df, ["t"], "ecl")
    assert [r.t for r in like.collect()] == ["Éclair"]
    assert sorted(r.t for r in filters.search(df, ["t"], "a_c", "like").collect()) == ["a_c", "abc"]
    assert [r.t for r in filters.search(df, ["t"], "a_c", "literal").collect()] == ["a_c"]
    assert filters.search(df, ["t"], "").count() == 3


def test_t4_attributes(spark):
    df = spark.createDataFrame([("[]",), ('{"Couleur":"Rouge"}',), ('["Rouge"]',), ("{bad",)], "a string")
    out = df.select(F.size(attrs.parse_attributes(F.col("a"))).alias("n"),
                    attrs.attributes_valid(F.col("a")).alias("ok")).collect()
    assert [(r.n, r.ok) for r in out] == [(0, True), (1, True), (0, False), (0, False)]


def test_t5_raw_json_search_is_case_sensitive(spark):
    df = spark.createDataFrame([(1, "x", None, '{"Couleur":"Rouge"}')], "id long, libelle string, reference string, attributs string")
    assert df.filter(filters.variation_search_predicate("rouge")).count() == 0
    assert df.filter(filters.variation_search_predicate("Rouge")).count() == 1


def test_t6_php_trim(spark):
    df = spark.createDataFrame([("\t Chaise \n",), (None,)], "s string")
    assert [r.t for r in df.select(php_trim(F.col("s")).alias("t")).collect()] == ["Chaise", ""]


def test_t7_falsy_default(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("A",)], "s string")
    assert [r.t for r in df.select(falsy_default(F.col("s"), "-").alias("t")).collect()] == ["-", "-", "-", "A"]


def test_t8_supplier_label(spark):
    df = spark.createDataFrame([(1, "B", "Ana", None)], "u_id long, u_nom string, u_prenom string, u_libelle string")
    assert df.select(listing.supplier_label().alias("l")).first().l == "Ana B ()"
    df2 = spark.createDataFrame([(None, None, None, None)], "u_id long, u_nom string, u_prenom string, u_libelle string")
    assert df2.select(listing.supplier_label().alias("l")).first().l == "-"
    assert df.select(php_concat(F.col("u_libelle"), "x").alias("c")).first().c == "x"


def test_t9_final_price(spark):
    df = spark.createDataFrame([(Decimal("0.100"), Decimal("0.200"))], "p decimal(10,3), s decimal(10,3)")
    r = df.select(prices.final_price_double(F.col("p"), F.col("s")).alias("d"),
                  prices.final_price_decimal(F.col("p"), F.col("s")).alias("x")).first()
    assert r.d == 0.30000000000000004
    assert r.x == Decimal("0.300")
    assert df.select(prices.price_text(F.col("p") + F.col("s")).alias("t")).first().t == "0.300 TND"


def test_t10_price_text_rules(spark):
    df = spark.createDataFrame([("12,5",), ("1.2345",), ("-3",), ("",), ("12345678.123",), ("abc",)], "p string")
    n = df.select(prices.normalise_price_text(F.col("p")).alias("p"))
    out = n.select("p", prices.parse_price(F.col("p")).alias("v"),
                   prices.price_matches_pattern(F.col("p")).alias("ok"),
                   prices.php_negative(F.col("p")).alias("neg")).collect()
    assert out[0].v == Decimal("12.500")
    assert out[1].ok is False and out[1].v is None
    assert out[2].ok is False and out[2].neg is True
    assert out[3].neg is True          # '' < '0' under PHP string comparison
    assert out[4].ok is True and out[4].v is None   # does not fit decimal(10,3): reported, no exception
    assert out[5].neg is False


def test_t12_t16_variation_sort(spark):
    df = spark.createDataFrame([(2, "B", None), (1, "b", "R2"), (3, "a", "R1")], "id long, libelle string, reference string")
    assert [r.id for r in df.orderBy(*listing.variation_sort(0, "asc")).collect()] == [3, 1, 2]
    assert [r.id for r in df.orderBy(*listing.variation_sort(2, "asc")).collect()] == [2, 3, 1]
    assert [r.id for r in df.orderBy(*listing.variation_sort(2, "desc")).collect()] == [1, 3, 2]
    assert [r.id for r in df.orderBy(*listing.variation_sort(9, "desc")).collect()] == [3, 2, 1]


def test_t14_clamp():
    assert listing.clamp_page(-5, 0, 100) == (0, 1)
    assert listing.clamp_page(3, 500, 100) == (3, 100)


def test_t17_t18_summary(spark):
    v = spark.createDataFrame([
        (1, 1, "a", "[]", Decimal("0"), 2, 0, None, False), (2, 1, "a", "[]", Decimal("0"), 3, 0, None, False),
        (3, 2, "a", "[]", Decimal("0"), 1, 0, None, False), (4, 2, "a", "[]", Decimal("0.5"), 1, 0, None, False),
        (5, 1, "a", "[]", Decimal("2.0"), 7, 0, None, True)], schemas.VARIATIONS)
    s = {r.product_id: (r.stock_total, r.has_price_supplement) for r in summary.stock_summary(v).collect()}
    assert s == {1: (5, False), 2: (2, True)}
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    out = {r.id: (r.stock, r.has_price_supplement) for r in listing.with_summary(rows, summary.stock_summary(v)).collect()}
    assert out[3] == (0, False)


def test_scl6_image_url(spark):
    df = spark.createDataFrame([("/3/a.png",), (None,), ("",)], "i string")
    out = [r.u for r in df.select(images.image_url(F.col("i")).alias("u")).collect()]
    assert out == ["uploads/products/3/a.png", images.PLACEHOLDER, images.PLACEHOLDER]


def test_scl7_scl8_strip_restore(spark):
    df = spark.createDataFrame([("uploads/products/3/a.jpg",), ("3/a.jpg",), (None,)], "i string")
    stripped = df.select(images.strip_legacy_prefix(F.col("i")).alias("i"))
    assert [r.i for r in stripped.collect()] == ["3/a.jpg", "3/a.jpg", None]
    restored = stripped.select(images.restore_legacy_prefix(F.col("i")).alias("i"))
    assert [r.i for r in restored.collect()] == ["uploads/products/3/a.jpg"] * 2 + [None]
    again = restored.select(images.strip_legacy_prefix(F.col("i")).alias("i"))
    assert again.collect() == stripped.collect()


def test_scl11_attribute_pairs(spark):
    df = spark.createDataFrame([([" Couleur", "couleur", "Taille", "Vide"], ["Rouge ", "Bleu", "M"])],
                               "n array<string>, v array<string>")
    m = df.select(attrs.normalise_pairs(F.col("n"), F.col("v")).alias("m")).first().m
    assert m == {"Couleur": "Rouge", "Taille": "M"}


def test_scl12_default_label(spark):
    df = spark.createDataFrame([("", {"Couleur": "Rouge", "Taille": "M"}, "P"), ("  ", {}, "P"), (" X ", {}, "P")],
                               "l string, a map<string,string>, p string")
    out = [r.x for r in df.select(attrs.default_label(F.col("l"), F.col("a"), F.col("p")).alias("x")).collect()]
    assert out == ["Rouge - M", "P", "X"]


def test_scl14_attribute_text(spark):
    df = spark.createDataFrame([('{"Couleur":"Rouge","Taille":"M"}',), ("[]",)], "a string")
    out = [r.t for r in df.select(attrs.attribute_text(F.col("a")).alias("t")).collect()]
    assert out == ["Couleur : Rouge, Taille : M", "Standard"]


def test_reference_base(spark):
    df = spark.createDataFrame([(7, "Été Rouge"), (7, "!!!"), (1234567, "a"), (7, "A & B @ C")], "p long, l string")
    out = [r.b for r in df.select(refs.reference_base(F.col("p"), F.col("l")).alias("b")).collect()]
    assert out == ["PRD-000007-ETE-ROUGE", "PRD-000007-STANDARD", "PRD-1234567-A", "PRD-000007-A-AND-B-AT-C"]
    long_label = "x" * 200
    b = spark.createDataFrame([(7, long_label)], "p long, l string").select(
        refs.reference_base(F.col("p"), F.col("l")).alias("b")).first().b
    assert len(b) == 100


def test_row_type():
    assert Row(a=1).a == 1


def test_proj4_supplier_option_label(spark):
    users = spark.createDataFrame(
        [(1, "Ben", "Ana", "a@x.tn", "ROLE_FOURNISSEUR", "Maison", False),
         (2, "Ben", "Ali", "b@x.tn", "ROLE_FOURNISSEUR", "0", False),
         (3, "Ben", "Sami", "c@x.tn", "ROLE_FOURNISSEUR", None, False)], schemas.USERS)
    got = {r.id: r.label for r in listing.supplier_options(users).collect()}
    assert got == {1: "Ben Ana (Maison)", 2: "Ben Ali", 3: "Ben Sami"}


def test_t5_parsed_attribute_search(spark):
    df = spark.createDataFrame([(1, "x", None, '{"Couleur":"Rouge"}'), (2, "x", None, "[]"),
                                (3, "x", None, '{"Matière":"Éclat"}')],
                               "id long, libelle string, reference string, attributs string")
    hits = lambda t: sorted(r.id for r in df.filter(filters.variation_search_predicate(t, raw_json=False)).collect())
    assert hits("rouge") == [1]
    assert hits("couleur") == [1]
    assert hits("eclat") == [3]
    assert hits("Priorite") == []
    assert hits('"') == []      # JSON punctuation is not part of a parsed name or value
