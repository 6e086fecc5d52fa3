"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source has a weight and a size in words. The mix is as large as the input.
A source's target is ``level * weight``, but never above ``max_epochs`` times its
size; what capped sources cannot take is shared among the others by weight until
no target is above its cap. The common level comes from one ordered pass over the
per-source table: sources reach their cap in order of cap / weight.

A source whose target is ``r`` times its size takes each document ``floor(r)``
times, and a seeded part of them once more. The part is cut by a per-source bound
on a hash of the document id, found with two histograms of words over the hash
(4,096 slots each), so no task ever sorts the documents of one source. Only the
per-source tables meet in one task.

Defined cases: a null text has size 0; documents of a null source form one source,
last in order; repeated ids share one hash, so they are taken alike; a null id
hashes like any other value; an empty table gives no rows; documents of size 0 are
taken 0 times; a source without words has target 0. Columns other than doc_id,
text and source are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import checkpointed, n_words_of, small_side

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20
SLOTS = 4096


def _draw(doc_id: Column, seed: int) -> Column:
    """A seeded hash of the id, 0 to 2**24 - 1."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(SLOTS * SLOTS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has source and size per document.

    One row per source is sorted in one task; sources are assumed to be named
    collections, far fewer than documents.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("__n", F.row_number().over(by_code_point) - 1).withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("__n", F.lit(len(weights)))))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("__cap", cap).withColumn("__at", F.col("__cap") / F.col("weight"))
    first_full = Window.orderBy("__at", "__n")
    before = first_full.rowsBetween(Window.unboundedPreceding, -1)
    rest = first_full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("__at", "__n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    # the level if exactly the sources before this one were capped; the first that stays under its cap sets it,
    # and the levels of those after it are lower
    per = per.withColumn("__level", left / F.sum("weight").over(rest))
    per = per.withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__at"), F.col("__level"))).over(everything))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap")))
    return per.select("source", "source_size", target.alias("target"))


def _bounds(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the hash bound below which a document is taken once more."""
    goal = targets.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))))
        .otherwise(F.lit(0)).cast("long").alias("whole"))
    goal = goal.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))

    def slot_cut(slots: DataFrame, wanted: str) -> DataFrame:
        """The slot of each source in which the running sum passes ``wanted``, and the sum before it."""
        run = Window.partitionBy("__source").orderBy("__slot")
        cum = slots.withColumn("__upto", F.sum("__words").over(run))
        return (cum.filter(F.col("__upto") > F.col(wanted))
                .groupBy("__source")
                .agg(F.min("__slot").alias("__slot"),
                     F.min_by(F.col("__upto") - F.col("__words"), F.col("__slot")).alias("__before"),
                     F.min_by("__words", "__slot").alias("__words")))

    same = F.col("source").eqNullSafe(F.col("__source"))
    coarse = (drawn.groupBy("source", F.floor(F.col("__h") / SLOTS).alias("__slot"))
              .agg(F.sum("size").alias("__words"))
              .join(goal, same).select("__source", "__slot", "__words", "goal"))
    cut = slot_cut(coarse, "goal").select(
        F.col("__source").alias("__cut_source"), F.col("__slot").alias("__coarse"), "__before")
    cut = goal.join(cut, F.col("__source").eqNullSafe(F.col("__cut_source"))).withColumn(
        "__goal", F.col("goal") - F.col("__before"))
    fine = (drawn.join(cut.select("__source", "__coarse", "__goal"),
                       same & (F.floor(F.col("__h") / SLOTS) == F.col("__coarse")))
            .groupBy("__source", "__goal", F.pmod("__h", F.lit(SLOTS)).alias("__slot"))
            .agg(F.sum("size").alias("__words")))
    last = slot_cut(fine, "__goal").select(
        F.col("__source").alias("__fine_source"), F.col("__slot").alias("__fine"),
        F.col("__before").alias("__fine_before"), F.col("__words").alias("__fine_words"))
    got = cut.join(last, F.col("__source").eqNullSafe(F.col("__fine_source")), "left")
    closer = F.col("__goal") - F.col("__fine_before") > F.col("__fine_words") / 2
    bound = F.col("__coarse") * SLOTS + F.coalesce(F.col("__fine"), F.lit(0)) + F.when(closer, 1).otherwise(0)
    cuts = got.select(F.col("__source").alias("__cut_source"), bound.alias("__bound"))
    return (goal.join(cuts, F.col("__source").eqNullSafe(F.col("__cut_source")), "left")
            .select("__source", "source_size", "target", "whole",
                    F.coalesce("__bound", F.lit(0)).cast("long").alias("__bound")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
             seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, source, size, hash; per source: size, target, repetitions, hash bound)."""
    drawn = checkpointed(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"),
                                     _draw(F.col("doc_id"), seed).alias("__h")))
    targets = checkpointed(source_targets(drawn, weights, max_epochs))
    return drawn, small_side(checkpointed(_bounds(drawn, targets)))  # one row per source


def _repeats() -> Column:
    return F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("__h") < F.col("__bound"), 1).otherwise(0)
                  ).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repeats, taken."""
    drawn, sources = mix_plan(docs, weights, max_epochs, seed)
    joined = drawn.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _repeats().alias("repeats"),
                         (F.col("size") * _repeats()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    seed: int = SEED) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns unchanged."""
    _, sources = mix_plan(docs, weights, max_epochs, seed)
    keep = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    rows = rows.select("row", F.col("row.source").alias("source"), n_words_of(F.col("row.text")).alias("size"),
                       _draw(F.col("row.doc_id"), seed).alias("__h"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    taken = rows.withColumn("__repeats", _repeats()).filter("__repeats > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__repeats"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in keep])
