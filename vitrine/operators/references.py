"""Unique variation references (SCL-16, WIN-2, section 2.12).

A generated reference is ``PRD-<product id>-<SLUG>``; when it is already used by
any row (deleted rows included) the reference tries ``-02``, ``-03``, ... in
variation id order. Because the product id is part of the text, candidates can
only meet inside one product, and inside a product only inside one *family*
(``functions.references.reference_family``), so the exact counter runs per
(product, family) group; the groups hold only the rows that lack a reference
plus the stored references of that same family.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import references as refs
from vitrine.operators import membership
from vitrine.operators.windows import row_number_by_id, sum_before
from vitrine.session import materialise

_PID_IN_REF = r"^PRD-([0-9]+)-"
_MAX_REFERENCE = refs.MAX_REFERENCE

# The Python task body is shipped by value, so executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_reference_base(variations: DataFrame) -> DataFrame:
    return variations.withColumn("base_reference", refs.reference_base(F.col("product_id"), F.col("libelle")))


def reference_sequence(variations: DataFrame) -> DataFrame:
    """WIN-2: window form of the counter for rows without a reference.

    Position among rows of the same product and base (id order) -> candidate
    ``base`` or ``base cut + '-NN'``. Exact when no stored reference or other
    base takes a candidate; ``assign_references`` handles those cases.
    """
    new = with_reference_base(variations.filter(F.col("reference").isNull() & F.col("product_id").isNotNull()))
    seq = row_number_by_id(new.select("id", "product_id", "base_reference"),
                           ["product_id", "base_reference"], out_col="seq")
    return seq.withColumn("candidate_reference", _window_candidate(F.col("base_reference"), F.col("seq")))


def _candidate(base: str, n: int) -> str:
    if n == 1:
        return base
    suffix = "-" + str(n).zfill(2)
    return base[:_MAX_REFERENCE - len(suffix)] + suffix


def _assign_partition(batches):
    """Sequential counter over one partition sorted by (pid, family, kind desc, id).

    Stored references (kind 1) of a group come before its new rows, so the set
    of used references is complete when the first new row is reached. State is
    kept across Arrow batches, so a group may span several batches.
    """
    key = None
    taken: set[str] = set()
    next_try: dict[str, int] = {}
    for pdf in batches:
        out_ids, out_pids, out_refs = [], [], []
        for vid, pid, fam, kind, ref in zip(pdf["id"].tolist(), pdf["pid"].tolist(), pdf["family"].tolist(),
                                            pdf["kind"].tolist(), pdf["ref"].tolist()):
            if (pid, fam) != key:
                key, taken, next_try = (pid, fam), set(), {}
            if kind == 1:
                taken.add(ref)
                continue
            n = next_try.get(ref, 1)
            candidate = _candidate(ref, n)
            while candidate in taken:
                n += 1
                candidate = _candidate(ref, n)
            # every candidate before n is taken and stays taken
            next_try[ref] = n
            taken.add(candidate)
            out_ids.append(vid)
            out_pids.append(pid)
            out_refs.append(candidate)
        yield pd.DataFrame({"id": pd.Series(out_ids, dtype="int64"),
                            "product_id": pd.Series(out_pids, dtype="int64"),
                            "reference": pd.Series(out_refs, dtype="object")})


def _keyed(rows: DataFrame, new: bool | None) -> DataFrame:
    """``id, pid, ref, kind, family`` of rows: kind 0 = needs a reference (``ref``
    is its base), kind 1 = stored reference (``ref`` in comparable form, ``pid``
    read from its prefix). ``new=None`` keeps both kinds from one pass."""
    is_new = F.col("reference").isNull() & F.col("product_id").isNotNull()
    stored_ref = refs.comparable_reference(F.col("reference"))
    base = refs.reference_base(F.col("product_id"), F.col("libelle"))
    if new is True:
        rows, is_new = rows.filter(is_new), F.lit(True)
    elif new is False:
        rows, is_new = rows.filter(F.col("reference").isNotNull()), F.lit(False)
    else:
        rows = rows.filter(is_new | F.col("reference").isNotNull())
    keyed = rows.select(
        "id",
        F.when(is_new, F.col("product_id"))
         .otherwise(F.regexp_extract(stored_ref, _PID_IN_REF, 1).try_cast("bigint")).alias("pid"),
        F.when(is_new, base).otherwise(stored_ref).alias("ref"),
        F.when(is_new, F.lit(0)).otherwise(F.lit(1)).alias("kind"))
    return (keyed.filter(F.col("pid").isNotNull())
            .withColumn("family", refs.reference_family(F.col("pid"), F.col("ref"))))


def assign_references(variations: DataFrame) -> DataFrame:
    """Reference for every variation that has none: ``id, product_id, reference``."""
    return _assign(_keyed(variations, None))


def assign_new_references(new_rows: DataFrame, table: DataFrame) -> DataFrame:
    """References for ``new_rows`` (rows without one), checked against every stored
    reference of ``table`` (deleted rows included): ``id, product_id, reference``."""
    news = _keyed(new_rows, True)
    # groups are keyed by product: only the references of products with a new row matter
    stored = membership.possible(_keyed(table, False), "pid", news, "pid").join(news.select("pid"), "pid", "left_semi")
    return _assign(news.unionByName(stored))


def _parent(base: Column) -> Column:
    """``base`` without its last ``-NN`` group when that group is a suffix the counter
    writes (``-%02d`` of n >= 2); NULL otherwise."""
    digits = F.regexp_extract(base, r"-([0-9]{2,})$", 1)
    n = digits.try_cast("bigint")
    ok = (digits != "") & (n >= 2) & (F.format_string("%02d", n) == digits)
    return F.when(ok, base.substr(F.lit(1), F.length(base) - F.length(digits) - 1))


def _split_families(rows: DataFrame) -> DataFrame:
    """Families whose new rows carry several bases, with one group per base
    (``rows``: keyed rows of families in which no candidate can be cut).

    A candidate of B is B or B + '-NN', so a reference matters to the base it equals and
    to the one that it extends. Two bases share a candidate only if one is the other
    plus one '-NN' group, and the child itself is all they share; who gets it is settled by
    ``_contests``. The loser then finds it stored, like any other reference, and every group has one base.
    """
    keys = ["pid", "family"]
    new = rows.filter(F.col("kind") == 0)
    stored = rows.filter(F.col("kind") == 1).select(*keys, "ref").distinct()
    bases = materialise(new.groupBy(*keys, F.col("ref").alias("base")).agg(F.min("id").alias("first")))
    children = bases.withColumn("parent", _parent(F.col("base"))).filter(F.col("parent").isNotNull())
    contested = materialise(
        children.join(bases.select(*keys, F.col("base").alias("parent")), [*keys, "parent"], "left_semi")
        .join(stored.withColumnRenamed("ref", "base"), [*keys, "base"], "left_anti"))
    met = stored.withColumn("base", F.col("ref")).unionByName(
        stored.withColumn("base", _parent(F.col("ref"))).filter(F.col("base").isNotNull()))
    met = met.join(bases.select(*keys, "base"), [*keys, "base"], "left_semi")
    if not contested.isEmpty():
        met = met.unionByName(_contests(new, met, contested))
    def group(base: str) -> Column:
        return F.concat(F.col("family"), F.lit("\u0001"), F.col(base)).alias("family")
    return new.select("id", "pid", "ref", "kind", group("ref")).unionByName(
        met.select(F.lit(None).cast("bigint").alias("id"), "pid", "ref", F.lit(1).alias("kind"), group("base")))


def _contests(new: DataFrame, met: DataFrame, contested: DataFrame) -> DataFrame:
    """pid, family, base, ref: for each child base that its parent's rows can reach, the base that finds it taken.

    The parent's rows take its free indices in id order, the child's first row asks for the child's own
    string. Let the child stand at index n, let ``taken`` be the parent's stored indices below n, ``before`` the parent's new rows
    before the child's first row, and W the children below n that won. The parent's row of rank n - taken - W reaches the string;
    the child is earlier if fewer parent rows than that came before it: W < n - taken - before. So per parent a count over
    its children (distinct bases, not rows) in index order settles all; what it needs of the rows are two running sums. A parent
    that lost its own string has one more index taken, so parents are settled before their children, level by level.
    """
    keys = ["pid", "family", "parent"]
    at = F.regexp_extract("base", r"-([0-9]{2,})$", 1).cast("bigint")
    asked = contested.withColumn("n", at)
    parents = asked.select(*keys).distinct()
    index = F.when(F.col("ref") == F.col("parent"), F.lit(1).cast("bigint")).otherwise(
        F.regexp_extract("ref", r"-([0-9]{2,})$", 1).cast("bigint"))
    held = met.withColumnRenamed("base", "parent").join(parents, keys, "left_semi").select(*keys, index.alias("n"), F.lit(1).alias("one"))
    taken = sum_before(held.unionByName(asked.select(*keys, "n", "base", F.lit(0).alias("one")), allowMissingColumns=True),
                       keys, "n", "one", "taken").filter("base is not null")
    mine = new.withColumnRenamed("ref", "parent").join(parents, keys, "left_semi").select(*keys, "id", F.lit(1).alias("one"))
    before = sum_before(mine.unionByName(asked.select(*keys, F.col("first").alias("id"), "base", F.lit(0).alias("one")),
                                         allowMissingColumns=True), keys, "id", "one", "before").filter("base is not null")
    room = (taken.join(before.select("pid", "family", "base", "before"), ["pid", "family", "base"])
            .select(*keys, "base", "n", (F.col("n") - F.col("taken") - F.col("before")).alias("room")))
    open_ = materialise(room)
    settled = None
    while not open_.isEmpty():
        waiting = open_.select("pid", "family", F.col("base").alias("parent"))
        now = open_.join(waiting, keys, "left_anti")
        if settled is not None:
            lost = settled.filter(~F.col("won")).select("pid", "family", F.col("base").alias("parent"), F.lit(1).alias("lost"))
            now = now.join(lost, keys, "left").withColumn("room", F.col("room") - F.coalesce("lost", F.lit(0))).drop("lost")
        done = materialise(now.groupBy(*keys).applyInPandas(_count_winners, "pid long, family string, parent string, base string, won boolean"))
        open_ = materialise(open_.join(done.select("pid", "family", "base"), ["pid", "family", "base"], "left_anti"))
        settled = done if settled is None else settled.unionByName(done)
    loser = F.when(F.col("won"), F.col("parent")).otherwise(F.col("base"))
    return settled.select("pid", "family", F.col("base").alias("ref"), loser.alias("base"))


def _count_winners(children: pd.DataFrame) -> pd.DataFrame:
    children = children.sort_values("n")
    won, out = 0, []
    for room in children["room"].tolist():
        out.append(won < room)
        won += out[-1]
    return children[["pid", "family", "parent", "base"]].assign(won=out)


def _group_stats(keyed: DataFrame) -> DataFrame:
    """Per (pid, family) with new rows: the base (if one), counts, path, and whether
    the family may be split (several bases, and no candidate can be cut)."""
    new_ref = F.when(F.col("kind") == 0, F.col("ref"))
    stats = (keyed.groupBy("pid", "family")
             .agg(F.min(new_ref).alias("__lo"), F.max(new_ref).alias("base"),
                  F.max(F.length(new_ref)).alias("__longest"),
                  F.sum(F.lit(1) - F.col("kind")).alias("n_new"),
                  F.sum("kind").alias("n_stored"))
             .filter(F.col("n_new") > 0))
    suffix_len = F.greatest(F.lit(2), F.length((F.col("n_new") + F.col("n_stored")).cast("string"))) + 1
    multi = F.col("__lo") != F.col("base")
    return stats.select(
        "pid", "family", "base", "n_new", "n_stored",
        F.when(multi, F.lit("multi")).when(F.col("n_stored") == 0, F.lit("simple"))
         .otherwise(F.lit("single")).alias("path"),
        (multi & (F.col("__longest") + suffix_len <= F.lit(_MAX_REFERENCE))).alias("__split"))


def _assign(keyed: DataFrame) -> DataFrame:
    """The counter over keyed rows (see ``_keyed``).

    Per (product, family) one partial/final aggregate finds whether the new
    rows share one base and counts new rows and stored references. Three exact
    paths follow:

    * one base, nothing stored: the k-th new row (id order) takes candidate k;
    * one base with stored references (``_single_base``): candidate indices
      already stored are found and the k-th new row takes the k-th free index,
      all with skew-safe numbering, so even a group holding a third of the table
      is spread over many tasks;
    * several bases whose candidates could be cut (labels near 100 characters, so the order of
      rows across bases matters): the sequential counter in one sorted pass per
      partition (``mapInPandas``).

    Before that, families with several bases and no cut candidate get one group per base
    (``_split_families``); only their rows take the extra joins. Families with no new row are
    dropped by the inner join.
    """
    keyed = materialise(keyed)
    cols = ["id", "pid", "ref", "kind", "family", "base", "n_new", "n_stored", "path"]
    stats = materialise(_group_stats(keyed))
    coarse = keyed.join(stats, ["pid", "family"])
    tagged = coarse.filter(~F.col("__split")).select(*cols)
    if not stats.filter("__split").isEmpty():
        refined = _split_families(coarse.filter(F.col("__split")).select("id", "pid", "ref", "kind", "family"))
        tagged = tagged.unionByName(refined.join(_group_stats(refined), ["pid", "family"]).select(*cols))
    # every path below reads the tagged rows; write them once instead of scanning
    # and joining the table again for each reader
    tagged = materialise(tagged)

    simple = tagged.filter(F.col("path") == "simple").select("id", "pid", "ref", "n_new")
    # a group of one row needs no number
    seq = row_number_by_id(simple.filter("n_new > 1"), ["pid", "ref"], out_col="seq").unionByName(
        simple.filter("n_new = 1").withColumn("seq", F.lit(1).cast("bigint")))
    simple_out = seq.select("id", F.col("pid").alias("product_id"),
                            _window_candidate(F.col("ref"), F.col("seq")).alias("reference"))

    single_out = _single_base(tagged.filter(F.col("path") == "single"))

    # Shuffle on an explicit hash of (pid, family) with a fixed partition count:
    # a repartition on columns the input is already partitioned by would be
    # dropped, and AQE would fold the Python stage into one task.
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = (tagged.filter(F.col("path") == "multi").select("id", "pid", "ref", "kind", "family")
            .withColumn("__group", F.xxhash64("pid", "family"))
            .repartition(parts, "__group")
            .sortWithinPartitions("__group", "pid", "family", F.col("kind").desc(), "id")
            .drop("__group"))
    complex_out = both.mapInPandas(_assign_partition, "id long, product_id long, reference string")
    return simple_out.unionByName(single_out).unionByName(complex_out)


def _single_base(rows: DataFrame) -> DataFrame:
    """Counter for families with one base B and stored references, without sequencing.

    Let t_1 < t_2 < ... be the candidate indices of B already stored (B itself is
    index 1, ``B cut + '-NN'`` is index NN). The k-th new row takes the k-th index
    not in that set, which is m = k + #{j : t_j - j < k}. That m is the row's
    position when new rows (key 2k) and stored indices (key 2(t_j - j) + 1) are
    ordered together, so it comes from the skew-safe row numbering. Stored
    indices above (new rows + stored references) of the family cannot be reached
    and are left out.
    """
    keys = ["pid", "family"]
    news = row_number_by_id(rows.filter(F.col("kind") == 0).select("id", *keys, "base"), keys, out_col="k")

    stored = rows.filter(F.col("kind") == 1)
    digits = F.regexp_extract(F.col("ref"), r"-([0-9]{2,})$", 1)
    n = F.when(F.col("ref") == F.col("base"), F.lit(1)).otherwise(digits.try_cast("bigint"))
    sfx = F.concat(F.lit("-"), digits)
    is_candidate = (F.col("ref") == F.col("base")) | (
        (n >= 2) & (F.format_string("%02d", n) == digits)
        & (F.concat(F.col("base").substr(F.lit(1), F.lit(_MAX_REFERENCE) - F.length(sfx)), sfx) == F.col("ref")))
    taken = (stored.select(*keys, n.alias("t"), is_candidate.alias("ok"), (F.col("n_new") + F.col("n_stored")).alias("cap"))
             .filter(F.col("ok") & (F.col("t") <= F.col("cap")))
             .select(*keys, "t").distinct())
    ranked = row_number_by_id(taken, keys, id_col="t", out_col="j")

    events = (news.select(*keys, "id", "base", (F.col("k") * 2).alias("okey"))
              .unionByName(ranked.select(*keys, F.lit(None).cast("long").alias("id"),
                                         F.lit(None).cast("string").alias("base"),
                                         ((F.col("t") - F.col("j")) * 2 + 1).alias("okey"))))
    placed = row_number_by_id(events, keys, id_col="okey", out_col="m")
    return (placed.filter(F.col("id").isNotNull())
            .select("id", F.col("pid").alias("product_id"),
                    _window_candidate(F.col("base"), F.col("m")).alias("reference")))


def _window_candidate(base, seq):
    suffix = F.format_string("-%02d", seq)
    cut = base.substr(F.lit(1), F.lit(refs.MAX_REFERENCE) - F.length(suffix))
    return F.when(seq == 1, base).otherwise(F.concat(cut, suffix))


def apply_references(variations: DataFrame, new_rows: DataFrame | None = None) -> DataFrame:
    """The variation table with generated references filled in (existing ones kept).

    With ``new_rows`` (a DataFrame with ``id``), only those rows get a reference;
    other rows without one are left as they are.
    """
    if new_rows is None:
        assigned = assign_references(variations)
    else:
        assigned = assign_new_references(variations.join(new_rows.select("id"), "id", "left_semi"), variations)
    assigned = assigned.select("id", F.col("reference").alias("__new_ref"))
    return (variations.join(assigned, "id", "left")
            .withColumn("reference", F.coalesce(F.col("reference"), F.col("__new_ref")))
            .drop("__new_ref"))
