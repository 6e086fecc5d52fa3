"""Batch change-apply on table snapshots (CHG-1..7, AGG-9).

A change set plus the current snapshot give the next snapshot; the input
directory is never overwritten. The application handles one request after
another, so each change of a batch is judged against the state that the accepted
changes before it leave (``seq`` order; changes with one ``seq`` in id order), and a
refused change leaves no trace. Rules that look at the change alone are column
expressions; the few parts of the state that a batch can move -- a product's supplier and
image, whether an id exists yet, who holds an e-mail -- are carried along by the
skew-safe functions of ``windows``, or settled in rounds (``emails``). Rejected changes are
returned next to the snapshot with the reference's message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import prices
from vitrine.functions.text import php_trim
from vitrine.operators import emails, filters, quality, summary
from vitrine.operators.references import assign_new_references
from vitrine.operators.windows import last_before
from vitrine.session import materialise
from vitrine.sources import schemas
from vitrine.sources.snapshots import next_version

# The reference's answers for a missing row and for refused access.
PRODUCT_NOT_FOUND = "Produit introuvable."
VARIATION_NOT_FOUND = "Variation introuvable."
USER_NOT_FOUND = "user_not_found"
ACCOUNT_DISABLED = "Ce compte est désactivé."
EDIT_DENIED = "Vous ne pouvez pas modifier ce produit."
DELETE_DENIED = "Vous ne pouvez pas supprimer ce produit."
VARIATION_DENIED = "Vous ne pouvez pas gérer les variations de ce produit."

# Rule of these jobs, without an equivalent in the application, which draws ids itself.
RESERVED_ID = "Variation ids from 4398046511104 on belong to default variations."

# Ids of default variations: this start value plus the id of the product, which is
# new. Other variations have ids below the start value (``check_variation_changes``).
DEFAULT_VARIATION_START = 1 << 42

_AT = "__at"


def in_order(changes: DataFrame) -> DataFrame:
    """The changes with their place in the batch: ``seq``, then id, then the other columns. Exact repeats are one change."""
    rest = [c for c in changes.columns if c not in ("id", "seq")]
    return changes.distinct().withColumn(_AT, F.struct("seq", "id", *rest))


def _accounts(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("__aid"), F.col("role").alias("__arole"), F.col("is_deleted").alias("__adel"))


def _refused_account() -> Column:
    return F.col("__aid").isNull() | F.coalesce(F.col("__adel"), F.lit(False))


def _is_admin() -> Column:
    return F.coalesce(F.col("__arole") == filters.ROLE_ADMIN, F.lit(False))


@dataclass
class ChangeResult:
    snapshot: DataFrame
    rejected: DataFrame
    accepted: DataFrame | None = None


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """Message of the first failing check, NULL when all pass."""
    out = None
    for bad, msg in checks:
        out = F.when(bad, F.lit(msg)) if out is None else out.when(bad, F.lit(msg))
    return out


def soft_delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the given ids flagged deleted; no cascade, already-deleted rows allowed."""
    hits = ids.select(F.col("id").alias("__hit")).distinct()
    return (table.join(hits, table.id == hits.__hit, "left")
            .withColumn("is_deleted", F.when(F.col("__hit").isNotNull(), F.lit(True)).otherwise(F.col("is_deleted")))
            .drop("__hit"))


def apply_product_deletes(products: DataFrame, users: DataFrame, requests: DataFrame) -> ChangeResult:
    """CHG-1: an existing product (deleted ones too) is deleted for an admin or its supplier."""
    p = products.select(F.col("id").alias("__pid"), F.col("fournisseur_id").alias("__owner"))
    asked = requests.select("id", "actor_id").distinct()
    checked = (asked.join(p, asked.id == p.__pid, "left")
               .join(_accounts(users), F.col("actor_id") == F.col("__aid"), "left"))
    reason = _first_reason(
        (F.col("__pid").isNull(), PRODUCT_NOT_FOUND),
        (_refused_account(), ACCOUNT_DISABLED),
        (~_is_admin() & ~F.col("__owner").eqNullSafe(F.col("actor_id")), DELETE_DENIED))
    checked = checked.select("id", reason.alias("reason"))
    accepted = checked.filter(F.col("reason").isNull()).select("id")
    return ChangeResult(soft_delete(products, accepted), checked.filter(F.col("reason").isNotNull()), accepted)


def apply_user_deletes(users: DataFrame, requests: DataFrame) -> ChangeResult:
    """CHG-3: an existing user (deleted ones too) is deleted; the request comes from an admin."""
    asked = requests.select("id").distinct()
    known = users.select(F.col("id").alias("__uid"))
    unknown = asked.join(known, asked.id == known.__uid, "left_anti")
    return ChangeResult(soft_delete(users, asked), unknown.select("id", F.lit(USER_NOT_FOUND).alias("reason")))


def check_variation_deletes(variations: DataFrame, products: DataFrame, users: DataFrame,
                            requests: DataFrame) -> DataFrame:
    """id, product_id and reason (NULL when accepted) of every request."""
    req = requests.select(F.col("id").alias("req_id"), "actor_id").distinct()
    v = variations.select(F.col("id").alias("__vid"), F.col("product_id").alias("__vpid"),
                          F.col("is_deleted").alias("__vdel"))
    p = products.select(F.col("id").alias("__pid"), F.col("is_deleted").alias("__pdel"),
                        F.col("fournisseur_id").alias("__owner"))
    checked = (req.join(v, req.req_id == v.__vid, "left")
               .join(p, F.col("__vpid") == F.col("__pid"), "left")
               .join(_accounts(users), F.col("actor_id") == F.col("__aid"), "left"))
    reason = _first_reason(
        (_refused_account(), ACCOUNT_DISABLED),
        (F.col("__vid").isNull() | F.coalesce(F.col("__vdel"), F.lit(False)), VARIATION_NOT_FOUND),
        (F.col("__pid").isNull() | F.coalesce(F.col("__pdel"), F.lit(False)), PRODUCT_NOT_FOUND),
        (~_is_admin() & ~F.col("__owner").eqNullSafe(F.col("actor_id")), VARIATION_DENIED))
    return checked.select(F.col("req_id").alias("id"), F.col("__vpid").alias("product_id"), reason.alias("reason"))


def apply_variation_deletes(variations: DataFrame, products: DataFrame, users: DataFrame,
                            requests: DataFrame) -> ChangeResult:
    """CHG-2: a variation is deleted when it and its product exist and are active, for an
    admin or the product's supplier."""
    checked = check_variation_deletes(variations, products, users, requests)
    accepted = checked.filter(F.col("reason").isNull()).select("id", "product_id")
    rejected = checked.filter(F.col("reason").isNotNull()).select("id", "reason")
    return ChangeResult(soft_delete(variations, accepted.select("id")), rejected, accepted)


def stock_after_deletes(variations: DataFrame, products: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """AGG-9: stock totals of the products that lose a variation, after the deletes.

    The variations are cut down to the touched products before the deleted ones
    are taken out, so the work after the semi join follows the change set.
    """
    accepted = materialise(check_variation_deletes(variations, products, users, requests)
                           .filter(F.col("reason").isNull()).select("id", "product_id"))
    touched = accepted.select(F.col("product_id").alias("id")).distinct()
    near = filters.by_keys(filters.active_strict(variations), touched, column="product_id")
    gone = accepted.select(F.col("id").alias("__gone"))
    left = near.join(gone, near.id == gone.__gone, "left_anti")
    return summary.refreshed_stock(left, accepted)


def check_intake(intake_rows: DataFrame, users: DataFrame, products: DataFrame,
                 variations: DataFrame | None = None) -> DataFrame:
    """Validated intake rows with ``reason`` (NULL when accepted): the first row of an id that passes adds
    the product, later ones find it stored. With ``variations``, a product is refused as stored too when the id of its
    default variation is taken."""
    checked = quality.validate_intake(in_order(intake_rows), users, products, keep=("seq", _AT))
    reason = F.col("first_message")
    if variations is not None:
        taken = variations.filter(F.col("id") >= DEFAULT_VARIATION_START).select(
            (F.col("id") - DEFAULT_VARIATION_START).alias("__taken"))
        checked = checked.join(taken, (checked.id == taken.__taken) & (checked.product_type == "standard"), "left")
        reason = F.coalesce(reason, F.when(F.col("__taken").isNotNull(), F.lit(quality.MSG["product_stored"])))
    checked = materialise(checked.withColumn("reason", reason))
    first = checked.filter(F.col("reason").isNull()).groupBy(F.col("id").alias("__fid")).agg(F.min(_AT).alias("__first"))
    stored = F.coalesce(F.col("__first") < F.col(_AT), F.lit(False))
    return (checked.join(first, checked.id == first.__fid, "left")
            .withColumn("reason", F.when(stored, F.lit(quality.MSG["product_stored"])).otherwise(F.col("reason")))
            .drop("__fid", "__first", "__taken"))


def intake(intake_rows: DataFrame, users: DataFrame, products: DataFrame, variations: DataFrame | None = None,
           checked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CHG-4: validate intake rows; return (new products, default variations, rejected).

    Both outputs are derived from the same validated rows, so a product is
    written only together with its default variation (``standard`` type).
    The new rows keep the intake ``id``, which may not be stored yet; a default
    variation's id is ``DEFAULT_VARIATION_START`` plus that id. ``checked`` may pass the rows of ``check_intake``.
    """
    if checked is None:
        checked = check_intake(intake_rows, users, products, variations)
    ok = checked.filter(F.col("reason").isNull())
    new_products = _conform(ok.select(
        "id", "libelle", "description", "image",
        prices.parse_price(F.col("prix")).alias("prix"), "fournisseur_id",
        F.lit(False).alias("is_deleted")), schemas.PRODUCTS)
    std = ok.filter(F.col("product_type") == "standard")
    defaults = _conform(std.select(
        (F.col("id") + DEFAULT_VARIATION_START).alias("id"), F.col("id").alias("product_id"), F.col("libelle"),
        F.lit("[]").alias("attributs"), F.lit(0).cast(schemas.PRICE).alias("prix_supplement"), F.col("stock"),
        F.lit(0).cast("bigint").alias("stock_utilise"), F.lit(None).cast("string").alias("reference"),
        F.lit(False).alias("is_deleted")), schemas.VARIATIONS)
    return new_products, defaults, checked.filter(F.col("reason").isNotNull()).select("id", "seq", "reason")


def with_default_references(defaults: DataFrame, variations: DataFrame) -> DataFrame:
    """Default variations with references assigned against every stored reference."""
    assigned = assign_new_references(defaults, variations.unionByName(defaults)) \
        .select("id", F.col("reference").alias("__ref"))
    return (defaults.join(assigned, "id", "left")
            .withColumn("reference", F.coalesce(F.col("reference"), F.col("__ref"))).drop("__ref")
            .select(*defaults.columns))


def intake_default_variations(intake_rows: DataFrame, users: DataFrame, products: DataFrame,
                              variations: DataFrame) -> DataFrame:
    """Default variations of accepted ``standard`` intake rows, with references assigned
    against every stored reference."""
    _, defaults, _ = intake(intake_rows, users, products, variations)
    return with_default_references(materialise(defaults), variations)


def write_intake(intake_rows: DataFrame, catalogue, out_root: str) -> None:
    """SNK-2 for CHG-4: the next version of ``catalogue`` under a new root.

    The intake is validated once (checkpointed), and products and default variations come from that
    one result, so a new product is never written without its default
    variation. The new version has every table of the catalogue (see ``snapshots.next_version``).
    """
    users, products, variations = catalogue.users, catalogue.products, catalogue.product_variations
    checked = materialise(check_intake(intake_rows, users, products, variations))
    new_products, defaults, rejected = intake(intake_rows, users, products, variations, checked)
    defaults = with_default_references(defaults, variations)
    next_version(catalogue, out_root, {"products": products.unionByName(new_products),
                                       "product_variations": variations.unionByName(defaults)},
                 {"rejected_intake": rejected})


def write_change_result(result: ChangeResult, table: str, catalogue, out_root: str) -> None:
    """SNK-3: the next version of ``catalogue`` with ``table`` changed, and the rejected changes, under a new root."""
    next_version(catalogue, out_root, {table: result.snapshot}, {f"rejected_{table}": result.rejected})


def apply_product_updates(products: DataFrame, users: DataFrame, updates: DataFrame) -> ChangeResult:
    """CHG-5: product edits by admins or the owning supplier.

    Checks in the reference's order: product exists (deleted ones too, T15),
    actor may sign in, actor is admin or owner, entity rules, and for admins the
    chosen supplier is an active supplier (others keep themselves as supplier).
    Image: removed when asked, replaced by a new upload (its key must be well formed
    and in the folder of the product's supplier), else kept.

    What an admin's change needs is known without the changes before it, and only admins move a
    product to another supplier. So the owner that a change meets is the supplier of the last
    passing admin change before it, else the stored one.
    """
    actors = _accounts(users)
    sup = filters.active_suppliers(users).select(F.col("id").alias("__sid"))
    cur = products.select(*[F.col(c).alias("old_" + c) for c in ("id", "fournisseur_id", "image")])
    u = in_order(updates).select(
        "id", "seq", _AT, "actor_id", F.coalesce("remove_image", F.lit(False)).alias("remove_image"), "new_image",
        php_text("libelle"), php_text("description"),
        prices.normalise_price_text(F.col("prix")).alias("prix"),
        F.col("fournisseur_id").alias("req_fournisseur_id"))
    j = (u.join(cur, u.id == cur.old_id, "left")
         .join(actors, u.actor_id == actors.__aid, "left")
         .join(sup, u.req_fournisseur_id == sup.__sid, "left"))
    is_admin = _is_admin()
    supplier = F.when(is_admin, F.col("req_fournisseur_id")).otherwise(F.col("actor_id"))
    entity = quality.violations(quality.product_rules(F.col("libelle"), F.col("description"), F.col("prix")))
    before_owner = (F.when(F.col("old_id").isNull(), F.lit(PRODUCT_NOT_FOUND))
                    .when(_refused_account(), F.lit(ACCOUNT_DISABLED)))
    after_owner = (F.when(F.size(entity) > 0, F.get(entity, 0)["message"])
                   .when(is_admin & F.col("__sid").isNull(), F.lit(quality.MSG["supplier_invalid"]))
                   .when(F.col("new_image").isNotNull() & ~quality.image_key_allowed(F.col("new_image"), supplier),
                         F.lit(quality.MSG["image_invalid"])))
    image = F.when(F.col("new_image").isNotNull() | F.col("remove_image"), F.struct(F.col("new_image").alias("key")))
    alone = j.select(
        "id", "seq", _AT, "libelle", "description", prices.parse_price(F.col("prix")).alias("prix"),
        supplier.alias("fournisseur_id"), image.alias("image"), "old_image", "old_fournisseur_id", "actor_id",
        is_admin.alias("is_admin"), before_owner.alias("before"), after_owner.alias("after"))
    passes = F.col("before").isNull() & F.col("after").isNull()
    alone = alone.withColumn("moves_to", F.when(F.col("is_admin") & passes, F.col("fournisseur_id")))
    met = last_before(alone, ["id"], _AT, {"owner": "moves_to"})
    denied = ~F.col("is_admin") & ~F.coalesce("owner", "old_fournisseur_id").eqNullSafe(F.col("actor_id"))
    reason = F.coalesce("before", F.when(denied, F.lit(EDIT_DENIED)), "after")
    checked = materialise(met.withColumn("reason", reason))
    accepted = checked.filter(F.col("reason").isNull()).select(
        "id", _AT, "libelle", "description", "prix", "fournisseur_id", "image", "old_image")
    rejected = checked.filter(F.col("reason").isNotNull()).select("id", "seq", "reason")
    fields = ("libelle", "description", "prix", "fournisseur_id")
    final = accepted.groupBy(F.col("id").alias("__uid")).agg(
        F.max_by(F.struct(*fields), _AT).alias("__new"),
        F.max_by("image", F.when(F.col("image").isNotNull(), F.col(_AT))).alias("__image"))
    merged = products.join(final, products.id == final.__uid, "left")
    hit = F.col("__uid").isNotNull()
    snap = merged.select(
        "id", *[F.when(hit, F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(F.col("__image").isNotNull(), F.col("__image")["key"]).otherwise(F.col("image")).alias("image"), "is_deleted")
    return ChangeResult(_conform(snap, schemas.PRODUCTS), rejected, accepted)


def replaced_image_keys(result: ChangeResult) -> DataFrame:
    """id, image: image files that accepted product updates leave without their product, stored ones and
    ones that an earlier change of the batch brought."""
    images = result.accepted.filter(F.col("image").isNotNull())
    met = last_before(images, ["id"], _AT, {"before": "image"})
    old = F.when(F.col("before").isNotNull(), F.col("before")["key"]).otherwise(F.col("old_image"))
    new = F.col("image")["key"]
    return met.filter(old.isNotNull() & (old != "") & ~old.eqNullSafe(new)).select("id", old.alias("image"))


def php_text(name: str) -> Column:
    return php_trim(F.col(name)).alias(name)


def _judged_variations(variations: DataFrame, products: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    """Ordered changes, normalised, with ``reason`` (NULL when accepted); each as if the others were not there."""
    cur = variations.select(F.col("id").alias("__vid"), F.col("product_id").alias("__vpid"),
                            F.col("is_deleted").alias("__vdel"), F.col("stock_utilise").alias("__used"),
                            F.col("reference").alias("__ref"))
    c = changes.join(cur, changes.id == cur.__vid, "left")
    is_update = F.col("__vid").isNotNull()
    c = c.withColumn("product_id", F.when(is_update, F.col("__vpid")).otherwise(F.col("product_id"))).drop("__vpid")
    norm = quality.normalise_variation_changes(
        c, products, keep=("seq", _AT, "actor_id", "__vid", "__vdel", "__used", "__ref"))
    p = products.select(F.col("id").alias("__pid"), F.col("is_deleted").alias("__pdel"),
                        F.col("fournisseur_id").alias("__owner"))
    norm = (norm.join(p, norm.product_id == p.__pid, "left")
            .join(_accounts(users), F.col("actor_id") == F.col("__aid"), "left"))
    used = F.coalesce(F.col("__used"), F.lit(0)).cast("bigint")
    entity = quality.violations(quality.variation_rules(F.col("libelle"), F.col("prix_supplement"),
                                                        F.col("stock"), used, F.col("__ref")))
    parent_missing = F.col("__pid").isNull() | F.coalesce(F.col("__pdel"), F.lit(False))
    reason = (F.when(~is_update & (F.col("id") >= DEFAULT_VARIATION_START), F.lit(RESERVED_ID))
              .when(_refused_account(), F.lit(ACCOUNT_DISABLED))
              .when(is_update & F.coalesce(F.col("__vdel"), F.lit(False)), F.lit(VARIATION_NOT_FOUND))
              .when(parent_missing, F.lit(PRODUCT_NOT_FOUND))
              .when(~_is_admin() & ~F.col("__owner").eqNullSafe(F.col("actor_id")), F.lit(VARIATION_DENIED))
              .when(~F.col("attributs_ok"), F.lit(quality.MSG["attributes_invalid"]))
              .when(F.col("stock").isNull(), F.lit(quality.MSG["stock_not_integer"]))
              .when(F.size(entity) > 0, F.get(entity, 0)["message"]))
    return norm.withColumn("__used", used).withColumn("reason", reason).select(
        "id", "seq", _AT, "product_id", "libelle", "attributs", "prix_supplement", "stock", "__used",
        "__ref", F.col("__vid").isNotNull().alias("__stored"), "reason")


def check_variation_changes(variations: DataFrame, products: DataFrame, users: DataFrame,
                            changes: DataFrame) -> DataFrame:
    """CHG-6 checks: normalised change rows with ``reason`` (NULL when accepted).

    An update needs an active variation and an active parent; an insert needs
    an active parent (lenient); both need an admin or the parent's supplier. Attributes
    that cannot be read, and prices that cannot be stored, are refused, and so is an insert with an id of the
    default variations' range. Fields are normalised as the form handler does;
    an update keeps the variation's product, used stock (``__used``) and stored
    reference (``__ref``).

    Of the state, a batch can only add the row itself: the first passing change of a new id inserts it, and the later
    ones are updates, judged again with the product of that row.
    """
    asked = in_order(changes)
    alone = materialise(_judged_variations(variations, products, users, asked))
    added = alone.filter(~F.col("__stored") & F.col("reason").isNull()).groupBy(F.col("id").alias("__nid")).agg(
        F.min(F.struct(_AT, "product_id")).alias("__insert"))
    first = F.col("__insert")
    later = alone.join(added, (alone.id == added.__nid) & (F.col(_AT) > first[_AT]), "inner").select(
        _AT, first["product_id"].alias("__product"))
    if later.isEmpty():
        return alone
    again = asked.join(later.withColumnRenamed(_AT, "__again"), F.col(_AT) == F.col("__again")).withColumn(
        "product_id", F.col("__product")).drop("__again", "__product")
    again = _judged_variations(variations, products, users, again)
    return alone.join(later.select(F.col(_AT).alias("__again")), F.col(_AT) == F.col("__again"), "left_anti").unionByName(again)


def apply_variation_changes(variations: DataFrame, products: DataFrame, users: DataFrame,
                            changes: DataFrame) -> ChangeResult:
    """CHG-6: variation inserts (unknown id) and updates (known id).

    Accepted rows replace or extend the table, the last accepted change of an id giving its fields. A changed row without
    a stored reference gets one from the exact counter when its first accepted change is applied, so from that change's
    label, checked against every stored reference (rows of one batch in id order); rows outside the change set are
    left as they are.
    """
    # the checked change set (its size, not the table's) feeds several joins below
    checked = materialise(check_variation_changes(variations, products, users, changes))
    fields = F.struct("product_id", "libelle", "attributs", "prix_supplement", "stock", "__used", "__ref")
    ok = materialise(checked.filter(F.col("reason").isNull()).groupBy("id").agg(
        F.max_by(fields, _AT).alias("__last"), F.min_by("libelle", _AT).alias("__first_label"))
        .select("id", "__last.*", "__first_label"))
    rows = _conform(ok.select(
        "id", "product_id", "libelle", "attributs",
        prices.parse_price(F.col("prix_supplement")).alias("prix_supplement"),
        "stock", F.col("__used").alias("stock_utilise"), F.col("__ref").alias("reference"),
        F.lit(False).alias("is_deleted")), schemas.VARIATIONS)
    kept = variations.join(rows.select("id"), "id", "left_anti")
    named = ok.select("id", "product_id", F.col("__first_label").alias("libelle"), F.col("__ref").alias("reference"))
    stored = kept.select("id", "product_id", "libelle", "reference").unionByName(named)
    assigned = assign_new_references(named, stored).select("id", F.col("reference").alias("__new"))
    rows = (rows.join(assigned, "id", "left")
            .withColumn("reference", F.coalesce(F.col("reference"), F.col("__new"))).drop("__new"))
    rejected = checked.filter(F.col("reason").isNotNull()).select("id", "seq", "reason")
    return ChangeResult(kept.unionByName(rows), rejected, rows)


def apply_user_changes(users: DataFrame, changes: DataFrame) -> ChangeResult:
    """CHG-7: user inserts and updates (no deleted check on edit, T15). The last accepted change of an id gives its
    fields; an e-mail is taken while another account holds it at that point of the batch (``emails``)."""
    checked = materialise(emails.check_user_changes(in_order(changes), users, _AT))
    ok = checked.filter(F.col("n_violations") == 0).groupBy("id").agg(
        F.max_by(F.struct("nom", "prenom", "email", "role", "libelle"), _AT).alias("__last")).select("id", "__last.*")
    cur = users.select(F.col("id").alias("__id"), F.col("is_deleted").alias("__del"))
    rows = (ok.join(cur, ok.id == cur.__id, "left")
            .withColumn("is_deleted", F.coalesce(F.col("__del"), F.lit(False))))
    rows = _conform(rows, schemas.USERS)
    snapshot = users.join(rows.select("id"), "id", "left_anti").unionByName(rows)
    rejected = checked.filter(F.col("n_violations") > 0).select("id", "seq", F.col("first_message").alias("reason"))
    return ChangeResult(snapshot, rejected)
