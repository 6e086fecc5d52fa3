"""Variation reference text (SCL-16): ``PRD-<product id, 6 digits>-<SLUG>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import strip_accents

# Reference layout, maximum length, slug used for an empty label,
# the symbol words of the slugger's default English locale, and letters whose
# ASCII form is not their decomposition.
REFERENCE_FORMAT = "PRD-%06d-"
MAX_REFERENCE = 100
EMPTY_SLUG = "STANDARD"
SLUG_SYMBOLS = {"@": "at", "&": "and"}
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O",
                   "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}


def slug(label: Column) -> Column:
    """Upper-cased ASCII slug: letters and digits kept, every other run becomes '-'."""
    text = F.coalesce(label, F.lit(""))
    for sym, word in SLUG_SYMBOLS.items():
        text = F.replace(text, F.lit(sym), F.lit(f" {word} "))
    for letter, ascii_form in SPECIAL_LETTERS.items():
        text = F.replace(text, F.lit(letter), F.lit(ascii_form))
    text = F.regexp_replace(strip_accents(text), "[^A-Za-z0-9]+", "-")
    return F.upper(F.btrim(text, F.lit("-")))


def reference_prefix(product_id: Column) -> Column:
    """``sprintf('PRD-%06d-', id)``: zero-padded to six digits, wider ids kept whole.

    Built with ``lpad`` (about three times cheaper per row than a formatter);
    negative ids, which the table never holds, fall back to the formatter.
    """
    digits = product_id.cast("string")
    padded = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.when(product_id >= 0, F.concat(F.lit("PRD-"), padded, F.lit("-"))) \
        .otherwise(F.format_string(REFERENCE_FORMAT, product_id))


def reference_prefix_length(product_id: Column) -> Column:
    return F.length(reference_prefix(product_id))


def reference_base(product_id: Column, label: Column) -> Column:
    """First candidate reference: prefix + slug, cut so the whole is at most 100 characters."""
    s = slug(label)
    s = F.when(s == "", F.lit(EMPTY_SLUG)).otherwise(s)
    prefix = reference_prefix(product_id)
    return F.concat(prefix, s.substr(F.lit(1), F.lit(MAX_REFERENCE) - F.length(prefix)))


def comparable_reference(reference: Column) -> Column:
    """Form under which stored references are compared: the table collation
    ignores case, accents and trailing spaces."""
    return F.upper(strip_accents(F.rtrim(reference)))


def reference_family(product_id: Column, reference: Column) -> Column:
    """Grouping key shared by a base reference and every candidate derived from it.

    Candidates of a base B are B and "B cut + '-NN'". All of them agree on
    ``root(first 40 characters)``, where ``root`` removes a trailing run of
    "-<digits>" groups (a cut suffix is still such a run); when that run reaches
    into the "PRD-000007-" prefix the prefix itself is the key. Because the key
    is a function of the reference text, two bases whose candidates can meet
    always share it, so grouping by (product id, key) keeps the counter exact.
    """
    prefix_len = reference_prefix_length(product_id)
    head = F.regexp_replace(F.substring(reference, 1, 40), r"(-[0-9]*)+$", "")
    return F.when(F.length(head) < prefix_len, reference.substr(F.lit(1), prefix_len)).otherwise(head)
