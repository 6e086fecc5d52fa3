"""DuckDB SQL fragments mirroring the Spark column expressions, for the oracles."""

from __future__ import annotations

# Stated here again, not imported, so that a wrong constant in the jobs shows up.
PRICE_PATTERN = r"^\d+(?:\.\d{1,3})?$"
NUMERIC = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EMAIL_PATTERN = (r"^[a-zA-Z0-9.!#$%&'*+\/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
                 r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$")
IMAGE_KEY_PATTERN = r"^[0-9]+/[0-9a-f]{32}\.(jpg|jpeg|png|webp)$"
LEGACY_PREFIX = "uploads/products/"
MAX_LABEL = 255
MAX_REFERENCE = 100
MSG = {
    "product_label_blank": "Le libellé est obligatoire.",
    "label_too_long": "Le libellé ne peut pas dépasser 255 caractères.",
    "description_blank": "La description est obligatoire.",
    "price_blank": "Le prix est obligatoire.",
    "price_pattern": "Le prix doit être un nombre avec au maximum 3 décimales.",
    "price_negative": "Le prix doit être positif ou égal à zéro.",
    "variation_label_blank": "Le libellé de la variation est obligatoire.",
    "supplement_blank": "Le supplément de prix est obligatoire.",
    "supplement_pattern": "Le supplément doit être un nombre avec au maximum 3 décimales.",
    "supplement_negative": "Le supplément de prix doit être positif ou égal à zéro.",
    "stock_negative": "Le stock doit être positif ou égal à zéro.",
    "used_stock_negative": "Le stock utilisé doit être positif ou égal à zéro.",
    "reference_too_long": "La référence ne peut pas dépasser 100 caractères.",
    "last_name_blank": "Le nom est obligatoire.",
    "first_name_blank": "Le prénom est obligatoire.",
    "too_long": "This value is too long. It should have 255 characters or less.",
    "email_blank": "L’email est obligatoire.",
    "email_invalid": "L’adresse email est invalide.",
    "role_invalid": "Le rôle sélectionné est invalide.",
    "email_taken": "Cet email est déjà utilisé.",
    "trade_name_blank": "Le libellé du fournisseur est obligatoire.",
    "type_invalid": "Le type de produit sélectionné est invalide.",
    "stock_not_integer": "Le stock doit être un nombre entier.",
    "supplier_invalid": "Le fournisseur sélectionné est invalide.",
    "price_range": "Le prix dépasse la valeur maximale.",
    "supplement_range": "Le supplément de prix dépasse la valeur maximale.",
    "product_stored": "Ce produit est déjà enregistré.",
    "add_denied": "Vous ne pouvez pas ajouter de produit.",
    "image_invalid": "L’image doit être au format JPEG, PNG ou WebP et ne pas dépasser 5 Mo.",
    "attributes_invalid": "Les caractéristiques ne sont pas un objet JSON.",
}

TRIM_SET = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11)"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def php_trim(expr: str) -> str:
    return f"trim(coalesce({expr}, ''), {TRIM_SET})"


def norm_price(expr: str) -> str:
    return f"replace({php_trim(expr)}, ',', '.')"


def price_ok(expr: str) -> str:
    return f"regexp_matches({expr}, {q(PRICE_PATTERN)})"


def parse_price(expr: str) -> str:
    return f"CASE WHEN {price_ok(expr)} THEN TRY_CAST({expr} AS DECIMAL(10,3)) END"


def out_of_range(expr: str) -> str:
    return f"{price_ok(expr)} AND TRY_CAST({expr} AS DECIMAL(10,3)) IS NULL"


def image_key_ok(expr: str, supplier: str) -> str:
    return (f"(regexp_matches({expr}, {q(IMAGE_KEY_PATTERN)}) "
            f"AND coalesce(TRY_CAST(split_part({expr}, '/', 1) AS BIGINT) = {supplier}, false))")


def readable_attributes(expr: str) -> str:
    return (f"({expr} IS NULL OR regexp_replace({expr}, '\\s', '', 'g') = '[]' "
            f"OR coalesce(CASE WHEN json_valid({expr}) THEN json_type({expr}) = 'OBJECT' END, false))")


def php_negative(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL THEN false WHEN regexp_matches({expr}, {q(NUMERIC)}) "
            f"THEN TRY_CAST({expr} AS DOUBLE) < 0 ELSE {expr} < '0' END")


def php_int(expr: str) -> str:
    t = php_trim(expr)
    return f"CASE WHEN regexp_matches({t}, '^[+-]?(0|[1-9][0-9]*)$') THEN TRY_CAST({t} AS BIGINT) END"


def blank(expr: str) -> str:
    return f"({expr} IS NULL OR {expr} = '')"


def filled(expr: str) -> str:
    return f"({expr} IS NOT NULL AND {expr} <> '')"


def too_long(expr: str, n: int) -> str:
    return f"coalesce(length({expr}) > {n}, false)"


def fold(expr: str) -> str:
    return f"lower(strip_accents({expr}))"


def fold_key(expr: str) -> str:
    return f"rtrim(lower(strip_accents({expr})))"


def report(rules: list[tuple[str, str, str]]) -> str:
    """``n_violations, first_message, paths`` of a rule list (path, message, SQL condition)."""
    conds = [f"coalesce({c}, false)" for _, _, c in rules]
    n = " + ".join(f"CAST({c} AS BIGINT)" for c in conds)
    first = "CASE " + " ".join(f"WHEN {c} THEN {q(m)}" for c, (_, m, _) in zip(conds, rules)) + " END"
    paths = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN {q(p)} END" for c, (p, _, _) in zip(conds, rules)) + ")"
    return f"CAST({n} AS BIGINT) AS n_violations, {first} AS first_message, {paths} AS paths"


def first_message(rules: list[tuple[str, str, str]]) -> str:
    conds = [f"coalesce({c}, false)" for _, _, c in rules]
    return "CASE " + " ".join(f"WHEN {c} THEN {q(m)}" for c, (_, m, _) in zip(conds, rules)) + " END"


def product_rules(lib: str, desc: str, prix: str) -> list[tuple[str, str, str]]:
    M = MSG
    return [
        ("libelle", M["product_label_blank"], blank(lib)),
        ("libelle", M["label_too_long"], too_long(lib, MAX_LABEL)),
        ("description", M["description_blank"], blank(desc)),
        ("prix", M["price_blank"], blank(prix)),
        ("prix", M["price_pattern"], f"{filled(prix)} AND NOT {price_ok(prix)}"),
        ("prix", M["price_negative"], php_negative(prix)),
        ("prix", M["price_range"], out_of_range(prix)),
    ]


def variation_rules(lib: str, sup: str, stock: str, used: str, ref: str) -> list[tuple[str, str, str]]:
    M = MSG
    return [
        ("libelle", M["variation_label_blank"], blank(lib)),
        ("libelle", M["label_too_long"], too_long(lib, MAX_LABEL)),
        ("prixSupplement", M["supplement_blank"], blank(sup)),
        ("prixSupplement", M["supplement_pattern"], f"{filled(sup)} AND NOT {price_ok(sup)}"),
        ("prixSupplement", M["supplement_negative"], php_negative(sup)),
        ("prixSupplement", M["supplement_range"], out_of_range(sup)),
        ("stock", M["stock_negative"], f"{stock} < 0"),
        ("stockUtilise", M["used_stock_negative"], f"{used} < 0"),
        ("reference", M["reference_too_long"], too_long(ref, MAX_REFERENCE)),
    ]


def user_rules(nom: str, prenom: str, email: str, role: str, lib: str, taken: str) -> list[tuple[str, str, str]]:
    M = MSG
    return [
        ("email", M["email_taken"], taken),
        ("libelle", M["trade_name_blank"], f"{role} = 'ROLE_FOURNISSEUR' AND {php_trim(lib)} = ''"),
        ("nom", M["last_name_blank"], blank(nom)),
        ("nom", M["too_long"], too_long(nom, MAX_LABEL)),
        ("prenom", M["first_name_blank"], blank(prenom)),
        ("prenom", M["too_long"], too_long(prenom, MAX_LABEL)),
        ("email", M["email_blank"], blank(email)),
        ("email", M["email_invalid"], f"{filled(email)} AND NOT regexp_matches({email}, {q(EMAIL_PATTERN)})"),
        ("role", M["role_invalid"], f"{role} IS NOT NULL AND {role} NOT IN ('ROLE_ADMIN', 'ROLE_FOURNISSEUR')"),
    ]


def slug(expr: str) -> str:
    t = f"replace(replace(coalesce({expr}, ''), '@', ' at '), '&', ' and ')"
    return f"upper(trim(regexp_replace(strip_accents({t}), '[^A-Za-z0-9]+', '-', 'g'), '-'))"


def reference_base(pid: str, label: str) -> str:
    s = slug(label)
    prefix = f"printf('PRD-%06d-', {pid})"
    return (f"{prefix} || substr(CASE WHEN {s} = '' THEN 'STANDARD' ELSE {s} END, 1, 100 - length({prefix}))")


def has_legacy_prefix(expr: str) -> str:
    return f"starts_with({fold(expr)}, {q(LEGACY_PREFIX)})"


def strip_prefix(expr: str) -> str:
    return f"CASE WHEN {has_legacy_prefix(expr)} THEN substr({expr}, {len(LEGACY_PREFIX) + 1}) ELSE {expr} END"


def attribute_text(expr: str) -> str:
    keys = f"json_keys({expr})"
    body = (f"array_to_string(list_transform({keys}, lambda k: k || ' : ' || "
            f"coalesce(json_extract_string({expr}, '$.\"' || k || '\"'), '')), ', ')")
    return f"CASE WHEN coalesce(len({keys}), 0) = 0 THEN 'Standard' ELSE {body} END"


def attribute_values(expr: str) -> str:
    return (f"array_to_string(list_transform(json_keys({expr}), lambda k: "
            f"json_extract_string({expr}, '$.\"' || k || '\"')), ' - ')")
