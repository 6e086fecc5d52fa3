"""Explicit schemas of the catalogue tables and of the change sets.

The password column of ``users`` is never part of a schema here: it is a secret
and no job needs it.
"""

from pyspark.sql import types as T

PRICE = T.DecimalType(10, 3)

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("nom", T.StringType(), True),
    T.StructField("prenom", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("is_deleted", T.BooleanType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("image", T.StringType(), True),
    T.StructField("prix", PRICE, True),
    T.StructField("fournisseur_id", T.LongType(), True),
    T.StructField("is_deleted", T.BooleanType(), True),
])

VARIATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("attributs", T.StringType(), True),
    T.StructField("prix_supplement", PRICE, True),
    T.StructField("stock", T.LongType(), True),
    T.StructField("stock_utilise", T.LongType(), True),
    T.StructField("reference", T.StringType(), True),
    T.StructField("is_deleted", T.BooleanType(), True),
])

# Incoming rows are raw text, the way a form posts them. ``seq`` is the order of the
# changes of one id, ``actor_id`` the account that asks.
PRODUCT_INTAKE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("prix", T.StringType(), True),
    T.StructField("product_type", T.StringType(), True),
    T.StructField("stock", T.StringType(), True),
    T.StructField("fournisseur_id", T.LongType(), True),
    T.StructField("actor_id", T.LongType(), True),
    T.StructField("image", T.StringType(), True),
    T.StructField("seq", T.LongType(), True),
])

PRODUCT_UPDATES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("prix", T.StringType(), True),
    T.StructField("fournisseur_id", T.LongType(), True),
    T.StructField("remove_image", T.BooleanType(), True),
    T.StructField("new_image", T.StringType(), True),
    T.StructField("actor_id", T.LongType(), True),
    T.StructField("seq", T.LongType(), True),
])

VARIATION_CHANGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("attributs", T.StringType(), True),
    T.StructField("prix_supplement", T.StringType(), True),
    T.StructField("stock", T.StringType(), True),
    T.StructField("actor_id", T.LongType(), True),
    T.StructField("seq", T.LongType(), True),
])

USER_CHANGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("nom", T.StringType(), True),
    T.StructField("prenom", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("libelle", T.StringType(), True),
    T.StructField("seq", T.LongType(), True),
])

IDS = T.StructType([T.StructField("id", T.LongType(), False)])
# Delete requests: the row and who asks.
DELETES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("actor_id", T.LongType(), True)])

TABLES = {
    "users": USERS,
    "products": PRODUCTS,
    "product_variations": VARIATIONS,
}
