"""Text expressions shared by every job (traps T2, T3, T6, T7, T8).

All of them are built-in column expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters PHP's trim() strips by default
# (space, tab, newline, carriage return, NUL, vertical tab).
PHP_TRIM_CHARS = " \t\n\r\0\x0b"


def _accent_table() -> tuple[str, str]:
    """Latin letters with diacritics -> their ASCII base letter.

    Built from the Unicode decomposition of Latin-1 Supplement and Latin
    Extended-A/B (U+00C0..U+024F): a letter is kept when its canonical
    decomposition starts with an ASCII letter.
    """
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, ACCENT_BASE = _accent_table()


def php_trim(c: Column) -> Column:
    """``trim((string) $x)``: NULL becomes '' and the PHP whitespace set is stripped."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(PHP_TRIM_CHARS))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, ACCENT_BASE)


def fold(c: Column) -> Column:
    """Case- and accent-insensitive form used for search, grouping and joins.

    Computed once per row as a plain binary string, so joins and aggregations on
    it use the fast binary hash instead of collation-aware comparison.
    """
    return F.lower(strip_accents(c))


def fold_key(c: Column) -> Column:
    """``fold`` plus the PAD SPACE rule of the table collation (trailing spaces ignored)."""
    return F.rtrim(fold(c))


def falsy_default(c: Column, default: str) -> Column:
    """PHP ``$x ?: default``: NULL, '' and '0' are all empty."""
    return F.when(c.isNull() | c.isin("", "0"), F.lit(default)).otherwise(c)


def php_concat(*parts: Column | str) -> Column:
    """PHP string concatenation: a NULL part contributes ''."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]
    return F.concat(*cols)


def like_text(term: str) -> str:
    """The term as part of a LIKE pattern: ``%`` and ``_`` stay wildcards, and a
    backslash stays an escape only before one of them."""
    return re.sub(r"\\(?![%_])", r"\\\\", term)


def search_predicate(columns: list[Column], term: str | None, mode: str = "like") -> Column | None:
    """OR of ``col LIKE '%term%'`` over ``columns`` under the case/accent-insensitive collation.

    ``mode='like'`` keeps the reference's behaviour where ``%`` and ``_`` typed by
    the user act as wildcards; ``mode='literal'`` matches the text as typed.
    Returns None for a blank term (no filter).
    """
    if term is None or term == "":
        return None
    folded_term = F.lower(strip_accents(F.lit(like_text(term) if mode == "like" else term)))
    if mode == "like":
        pattern = F.concat(F.lit("%"), folded_term, F.lit("%"))
        preds = [F.like(fold(c), pattern) for c in columns]
    elif mode == "literal":
        preds = [F.contains(fold(c), folded_term) for c in columns]
    else:
        raise ValueError(f"unknown search mode {mode!r}")
    return reduce(lambda a, b: a | b, preds)


def binary_like_predicate(c: Column, term: str) -> Column:
    """Case-sensitive LIKE on raw text (JSON columns carry a binary collation, T5)."""
    return F.like(c, F.lit("%" + like_text(term) + "%"))
