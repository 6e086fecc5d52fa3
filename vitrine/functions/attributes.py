"""Variation attribute expressions (T4, SCL-11, SCL-12, SCL-14, SCL-15).

Attributes are stored as JSON text: an object of name -> value, or ``[]`` when
empty (PHP encodes an empty array as a list). Everything here is a built-in
map/array expression evaluated per row; arrays only ever hold one row's own
form fields, so their size is bounded by the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import php_trim

MAP_TYPE = "map<string,string>"
# Label shown for a variation without attributes, the separator
# of generated labels, and the name/value separator of the attribute text.
NO_ATTRIBUTES = "Standard"
LABEL_SEPARATOR = " - "
PAIR_SEPARATOR = " : "
LIST_SEPARATOR = ", "


def parse_attributes(attributs: Column) -> Column:
    """JSON text -> map; ``[]`` and anything unreadable -> empty map."""
    return F.coalesce(F.from_json(attributs, MAP_TYPE), F.create_map().cast(MAP_TYPE))


def attributes_valid(attributs: Column) -> Column:
    """True for an object or the empty list ``[]``; false for other lists and bad JSON."""
    return (F.regexp_replace(attributs, r"\s", "") == "[]") | F.from_json(attributs, MAP_TYPE).isNotNull()


def stored_attributes(m: Column) -> Column:
    """Map -> the JSON text that is stored; an empty map is the empty list."""
    return F.when(F.size(m) == 0, F.lit("[]")).otherwise(F.to_json(m))


def attribute_text(attributs: Column) -> Column:
    """``name : value`` per entry in stored order, ``Standard`` when there is none."""
    def text(entries: Column) -> Column:
        pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit(PAIR_SEPARATOR), F.coalesce(e["value"], F.lit(""))))
        return F.when(F.size(entries) == 0, F.lit(NO_ATTRIBUTES)).otherwise(F.array_join(pairs, LIST_SEPARATOR))

    # bound to a lambda variable, so that the JSON is parsed once per row
    return F.get(F.transform(F.array(F.map_entries(parse_attributes(attributs))), text), F.lit(0))


def normalise_pairs(names: Column, values: Column) -> Column:
    """Form arrays of names and values -> attribute map.

    Names and values are zipped by position (a missing value is ''), trimmed,
    pairs with a blank side dropped, and the first spelling of a name wins over
    later ones that differ only by case.
    """
    zipped = F.transform(names, lambda n, i: F.struct(
        php_trim(n).alias("name"),
        php_trim(F.get(values, i)).alias("value")))
    kept = F.filter(zipped, lambda p: (p["name"] != "") & (p["value"] != ""))
    empty = F.array().cast("array<struct<name:string,value:string>>")
    first = F.aggregate(kept, empty, lambda acc, p: F.when(
        F.exists(acc, lambda q: F.lower(q["name"]) == F.lower(p["name"])), acc)
        .otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["name"].alias("key"),
                                                                    p["value"].alias("value"))))


def default_label(libelle: Column, attrs: Column, product_label: Column) -> Column:
    """Trimmed label; when blank, the attribute values joined by ' - ', else the product label."""
    trimmed = php_trim(libelle)
    generated = F.when(F.size(attrs) == 0, F.coalesce(product_label, F.lit(""))) \
        .otherwise(F.array_join(F.map_values(attrs), LABEL_SEPARATOR))
    return F.when(trimmed == "", generated).otherwise(trimmed)
