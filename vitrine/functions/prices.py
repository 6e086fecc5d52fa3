"""Price text rules (traps T9, T10) and price display text (SCL-4, SCL-5, SCL-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import php_trim
from vitrine.sources.schemas import PRICE

# The price pattern of the entity rules (at most three decimals),
# the currency suffix and the "from" prefix of the product grid.
PRICE_PATTERN = r"^\d+(?:\.\d{1,3})?$"
CURRENCY_SUFFIX = " TND"
FROM_PREFIX = "À partir de "
SUPPLEMENT_PREFIX = "+"

# A PHP numeric string (what decides numeric vs string comparison in PHP 8).
_NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalise_price_text(c: Column) -> Column:
    """``str_replace(',', '.', trim($x))``: every comma becomes a point."""
    return F.replace(php_trim(c), F.lit(","), F.lit("."))


def price_matches_pattern(c: Column) -> Column:
    return c.rlike(PRICE_PATTERN)


def parse_price(c: Column) -> Column:
    """Exact decimal(10,3) of a checked price text; NULL when the text fails the
    pattern or does not fit decimal(10,3). Checking before casting keeps
    ``1.2345`` from being rounded into a valid price."""
    return F.when(price_matches_pattern(c), c.try_cast(PRICE))


def price_out_of_range(c: Column) -> Column:
    """The text passes the pattern but does not fit decimal(10,3)."""
    return price_matches_pattern(c) & c.try_cast(PRICE).isNull()


def php_negative(c: Column) -> Column:
    """``$x >= 0`` is false for a text value under PHP 8 comparison rules.

    Numeric text compares as a number; other text compares as a string against
    ``'0'`` (so '' fails and 'abc' passes). NULL is skipped by the rule.
    """
    numeric = c.rlike(_NUMERIC)
    return (F.when(c.isNull(), F.lit(False))
            .when(numeric, c.try_cast("double") < 0)
            .otherwise(c < F.lit("0")))


def final_price_double(base: Column, supplement: Column) -> Column:
    """``(float) prix + (float) supplement`` as the reference computes it."""
    return base.cast("double") + supplement.cast("double")


def final_price_decimal(base: Column, supplement: Column) -> Column:
    return (base + supplement).cast("decimal(11,3)")


def price_text(amount: Column) -> Column:
    """``x.toFixed(3) + ' TND'`` for an exact 3-decimal amount."""
    return F.concat(amount.cast("decimal(11,3)").cast("string"), F.lit(CURRENCY_SUFFIX))


def listing_price_text(prix: Column, has_supplement: Column) -> Column:
    """Product grid price: prefixed with "À partir de " when a variation costs more."""
    text = price_text(prix)
    return F.when(has_supplement, F.concat(F.lit(FROM_PREFIX), text)).otherwise(text)


def supplement_text(supplement: Column) -> Column:
    return F.concat(F.lit(SUPPLEMENT_PREFIX), price_text(supplement))
