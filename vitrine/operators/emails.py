"""Who holds an e-mail while a batch of user changes is applied (CHG-7, DQ-13).

An account may take an address that an earlier change of the batch freed, and a third
account the one that it left in turn. Each change is judged at its place in the batch: the address is
taken while another account holds it, stored accounts (deleted ones too) included.

Most changes need no order: an address that one account alone holds or asks for is free for it. The rest is
settled in rounds. Known are the accepted changes, with the span of places for which each account holds an
address. In a round

* a change is refused if another account holds the address at its place for certain, that is with no open
  change of that account in between -- however many ask for one address, they go in one round;
* the first open change for an address is accepted if nobody else can hold it there;
* what else is open waits for an account that may leave the address first.

The first open change of the batch never waits, so every round settles something; the rounds are as many as the
longest chain of hand-overs. Per address only the two longest spans (of different accounts) matter, so a common
address is combined in every task, and no pairs of changes and holders are made. The changes of one
account are put in order by ``windows.last_before``, which spreads them over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import fold_key
from vitrine.operators import membership, quality
from vitrine.operators.windows import last_before, row_number_by_id
from vitrine.session import materialise

#: After the last place of any batch.
NEVER = (1 << 62)


def _next(events: DataFrame, **when: Column) -> DataFrame:
    """Add columns: the place of the account's next event (after this one) that satisfies each condition."""
    marked = events.withColumns({"__back": -F.col("pos"), **{f"__v_{k}": F.when(w, F.col("pos")) for k, w in when.items()}})
    return last_before(marked, ["id"], "__back", {k: f"__v_{k}" for k in when}).drop("__back", *[f"__v_{k}" for k in when])


def _two_longest(spans: DataFrame, until: str, out: str) -> DataFrame:
    """key, the greatest ``until`` with its account, and the greatest of another account."""
    top = spans.groupBy("key").agg(F.max(F.struct(until, "id")).alias("__top"))
    other = (spans.join(top, "key").filter(F.col("id") != F.col("__top")["id"])
             .groupBy("key").agg(F.max(until).alias(f"{out}_2")))
    return top.select("key", F.col("__top")[until].alias(f"{out}_1"), F.col("__top")["id"].alias(f"{out}_id")) \
        .join(other, "key", "left")


def _of_others(out: str) -> Column:
    """The longest span among the accounts other than the row's own; before any place if there is none."""
    own = F.col(f"{out}_id").eqNullSafe(F.col("id"))
    return F.coalesce(F.when(own, F.col(f"{out}_2")).otherwise(F.col(f"{out}_1")), F.lit(-2).cast("bigint"))


def _settled(events: DataFrame) -> DataFrame:
    """Accepted events (id, key, pos) of events that also have ``open``: true where the outcome is to be found."""
    events = materialise(events)
    while not events.filter("open").isEmpty():
        spans = _next(events, end=~F.col("open"), maybe=F.col("open"))
        heads = events.filter("open").groupBy("key").agg(F.min("pos").alias("head"))
        spans = spans.filter("not open").select("id", "key", F.coalesce("end", F.lit(NEVER)).alias("end"), "maybe")
        spans = spans.withColumn("safe", F.least("end", F.coalesce("maybe", F.lit(NEVER))))
        spans = materialise(spans.join(heads, "key").filter(F.col("end") > F.col("head")))
        asked = (events.filter("open").join(heads, "key").join(_two_longest(spans, "safe", "safe"), "key", "left")
                 .join(_two_longest(spans, "end", "end"), "key", "left"))
        verdict = (F.when(_of_others("safe") > F.col("pos"), F.lit("refused"))
                   .when((F.col("pos") == F.col("head")) & (_of_others("end") <= F.col("pos")), F.lit("accepted"))
                   .otherwise(F.lit("open")))
        asked = asked.withColumn("__verdict", verdict).filter("__verdict <> 'refused'")
        events = materialise(events.filter("not open").unionByName(
            asked.select("id", "key", "pos", (F.col("__verdict") == "open").alias("open"))))
    return events.drop("open")


def _taken(asked: DataFrame, accepted: DataFrame) -> DataFrame:
    """``asked`` (id, key, pos) with ``email_taken``, all accepted events known.

    Stored accounts hold an address from the start, so the two that keep it longest are enough. Of accounts that took it
    in the batch only the last before the place can still hold it: none takes an address while another has it.
    """
    spans = _next(accepted, end=F.lit(True)).withColumn("end", F.coalesce("end", F.lit(NEVER)))
    spans = materialise(spans)
    stored = _two_longest(spans.filter("pos < 0"), "end", "end")
    took = spans.filter("pos >= 0").select("id", "key", "pos", F.struct("id", "end").alias("held"))
    both = asked.withColumn("held", F.lit(None).cast("struct<id:bigint,end:bigint>")).withColumn("__ask", F.lit(True)).unionByName(
        took.select("id", "key", "pos", "held").withColumn("__ask", F.lit(False)))
    both = both.withColumn("__turn", F.struct("pos", (~F.col("__ask")).alias("took")))
    met = last_before(both, ["key"], "__turn", {"before": "held"}).filter("__ask").join(stored, "key", "left")
    by_taker = F.coalesce((F.col("before")["id"] != F.col("id")) & (F.col("before")["end"] > F.col("pos")), F.lit(False))
    return met.select("id", "pos", ((_of_others("end") > F.col("pos")) | by_taker).alias("email_taken"))


def check_user_changes(changes: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """Normalised user changes with their violations, each judged at its place ``at`` in the batch."""
    n = quality.normalise_users(changes, keep=("seq", at)).withColumn("key", fold_key(F.col("email")))
    n = row_number_by_id(n, [], id_col=at, out_col="pos")
    alone = quality.with_user_rules(n.withColumn("email_taken", F.lit(False)))
    n = materialise(n.join(alone.select("pos", (F.col("n_violations") == 0).alias("passes")), "pos"))
    held = users.select("id", fold_key(F.col("email")).alias("key"))
    mine = n.select("id").distinct()
    claims = n.filter("passes").select("id", "key", "pos")
    asked_keys = n.select("key").distinct()
    # stored holders of an address that is asked for, and what the batch's own accounts hold
    near = membership.possible(held, "key", asked_keys, "key").join(asked_keys, "key", "left_semi")
    own = membership.possible(held, "id", mine, "id").join(mine, "id", "left_semi")
    stored = materialise(near.select("id", "key").unionByName(own.select("id", "key"))
                         .distinct().withColumn("pos", F.lit(-1).cast("bigint")))
    events = stored.unionByName(claims)
    contested = events.groupBy("key").agg(F.min("id").alias("__a"), F.max("id").alias("__b")).filter("__a <> __b").select("key")
    open_claims = claims.join(contested, "key", "left_semi").withColumn("open", F.lit(True))
    known = stored.unionByName(claims.join(contested, "key", "left_anti")).withColumn("open", F.lit(False))
    accepted = _settled(known.unionByName(open_claims))
    taken = _taken(n.select("id", "key", "pos"), accepted)
    return quality.with_user_rules(n.drop("key", "passes").join(taken.select("pos", "email_taken"), "pos"))
