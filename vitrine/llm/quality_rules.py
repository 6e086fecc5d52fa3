"""Quality rules: fixed base rules, then risk-controlled cutoffs per stratum.

Five rates are measured on every whole text: symbols, capital letters and
exclamation marks per character of words, repeated lines per line, and words in
repeated 8-word windows per word. Each has a fixed list of cutoffs from loose to
strict. A document is rejected when a rate is above the cutoff of its stratum
(its language).

The cutoffs are chosen on all labelled documents. For a stratum with ``n`` good
labelled documents, ``x`` of them above a cutoff, the claim "more than alpha of the
good documents are rejected" is refuted when P(Bin(n, alpha) <= x) <= delta / m.
Cutoffs are tested in order, loose to strict, and testing stops at the first claim
that stands (fixed-sequence testing, which needs no correction along a list); the
m = strata x rates lists share delta (Bonferroni), and the rates share the
stratum's alpha. With probability 1 - delta, no stratum loses more than ``ALPHA``
of its good documents to the cutoffs. A list without a refuted claim has no cutoff.

Windows are compared by 64-bit hashes. All of it is column expressions: a
document's windows stay in its row, so nothing is shuffled but the rates of
labelled documents and the small cutoff table.

Defined cases: a null or empty text has no words and fails the base rules; a null
language is a stratum of its own; labels that are null, or neither 0 nor 1, do not
count; repeated ids or labels count each; a labelled id that is missing, or an
empty label table, leaves no cutoff; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, let, small_side, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ALPHA = 0.02
DELTA = 0.05
#: The rates that have cutoffs, and their cutoffs from loose to strict.
RATES = ("symbols", "capitals", "exclamations", "dup_lines", "repeats")
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given ascending positions."""
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        positions, start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text."""
    def repeated(hashes: Column) -> Column:
        def positions(order: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.coalesce(a["h"] == b["h"], F.lit(False))
            twice = F.filter(order, lambda e, j: same(F.get(order, j - 1), e) | same(F.get(order, j + 1), e))
            return F.array_sort(F.transform(twice, lambda e: e["p"]))
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes),
                      let(F.array_sort(pairs), lambda order: _covered(positions(order)))).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    return let(words, lambda w: F.when(F.size(w) > WINDOW, let(windows(w), repeated)).otherwise(F.lit(0)))


def with_measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns plus the measures of the text; nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(F.col("text"))
    measures = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(
        *[F.col(c) for c in carry], measures.alias("__m"), line_counts.alias("__l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"))
    out = out.select(*[F.col(c) for c in carry], "__m.*", "__l.*", "n_symbols", "n_capitals", "n_exclamations")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _rates() -> list[Column]:
    over = (("n_symbols", "word_chars"), ("n_capitals", "word_chars"), ("n_exclamations", "word_chars"),
            ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
    return [F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)) for a, b in over]


def _log_tail(n: Column, x: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= x), exact up to rounding.

    The terms t_0 .. t_x are summed relative to the last: with r_i = t_(i-1) / t_i the
    sum is t_x (1 + r_x (1 + r_(x-1) (...))), which stays in range for any n.
    """
    odds = p / (1 - p)
    start = F.struct((n * math.log(1 - p)).alias("lnt"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        up = (n - i + 1) / i * odds
        return F.struct((a["lnt"] + F.ln(up)).alias("lnt"), (1 + a["s"] / up).alias("s"))

    terms = F.filter(F.sequence(F.lit(0).cast("long"), x), lambda i: i > 0)
    tail = F.aggregate(F.transform(terms, lambda i: i.cast("double")), start, step, lambda a: a["lnt"] + F.ln(a["s"]))
    return F.when(x >= n, F.lit(0.0)).otherwise(tail)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum: lang, and one cutoff per rate (null: none). ``measured`` has doc_id, lang and the measures."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__id"))
    kept = measured.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("__id"))
    rate = F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in RATES]).alias("rate"), F.array(*_rates()).alias("v")))
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    counted = kept.select("lang", rate.alias("r")).select(
        "lang", F.col("r.rate").alias("rate"),
        F.size(F.filter(grid, lambda c: c >= F.col("r.v"))).alias("step"))
    counted = counted.groupBy("lang", "rate", "step").agg(F.count("*").alias("n"))
    # step = cutoffs (loose to strict) that the value passes; it is above cutoff number k when step <= k
    total = Window.partitionBy("lang", "rate")
    every = checkpointed(counted.groupBy("lang", "rate").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by_step")))
    m = max(1, every.count())
    tests = every.select(
        "lang", "rate", "n", "by_step", F.posexplode(grid).alias("k", "cutoff"))
    above = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0).cast("long"),
                        lambda a, s: a + F.coalesce(F.try_element_at(F.col("by_step"), s), F.lit(0).cast("long")))
    tests = tests.withColumn("x", above)
    tail = _log_tail(F.col("n").cast("double"), F.col("x"), alpha / len(RATES))
    tests = tests.withColumn("refuted", tail <= F.lit(math.log(delta / m)))
    stands = F.min(F.when(~F.col("refuted"), F.col("k"))).over(total)
    chosen = (tests.withColumn("__stop", stands)
              .filter(F.col("__stop").isNull() | (F.col("k") < F.col("__stop")))
              .groupBy("lang", "rate").agg(F.min("cutoff").alias("cutoff")))
    return chosen.groupBy("lang").agg(
        *[F.max(F.when(F.col("rate") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RATES])


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` plus kept; ``limits`` is the cutoff table."""
    limits = small_side(limits.withColumnRenamed("lang", "__stratum"))  # one row per language
    got = measured.join(limits, F.col("lang").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for name, value in zip(RATES, _rates()):
        rejected = rejected | F.coalesce(value > F.col(f"max_{name}"), F.lit(False))
    # one CASE, not a conjunction: a part of a conjunction would be pushed below the join, and the measures
    # behind it computed twice
    kept = F.when(F.col("base_failed") | rejected, F.lit(False)).otherwise(F.lit(True))
    return got.withColumn("kept", kept).drop(
        "__stratum", *[f"max_{r}" for r in RATES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, lang, all measures, base_failed, kept."""
    measured = checkpointed(with_measures(docs, ["doc_id", "lang"]))
    return verdicts(measured, checkpointed(cutoffs(measured, labels, alpha, delta)))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, columns unchanged.

    The texts are read twice, once for the cutoffs and once for the verdicts; they
    are never shuffled.
    """
    measured = checkpointed(with_measures(docs, ["doc_id", "lang"]))
    limits = checkpointed(cutoffs(measured, labels, alpha, delta))
    keep = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    rows = rows.select("row", F.col("row.text").alias("text"), F.col("row.lang").alias("lang"))
    judged = verdicts(with_measures(rows, ["row", "lang"]), limits).filter("kept")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in keep])
