"""Column functions of the geometry model. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Role patterns in their order of priority, display ranks and labels, severities.
ROLE_RULES = [
    ("dim(ension)?", "dimension", "name_dimension"),
    ("(anno|t?ext|label)", "annotation", "name_annotation"),
    ("(guide|constr(uction)?|xline)", "guide", "name_guide"),
    ("^(layer0|default|untagged)$", "construction", "name_default_layer"),
]
ROLE_ORDER = ["dimension", "annotation", "guide", "construction", "unknown"]
SEVERITY = {
    "duplicate_edge_candidate": "medium",
    "short_edge": "low",
    "open_endpoint": "medium",
    "gap_candidate": "medium",
    "significant_non_zero_z": "medium",
    "abnormal_large_coord": "high",
    "deep_nesting": "low",
}
ISSUE_TYPES = list(SEVERITY)
DEFAULT_LAYER = "Layer0"


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def finite(*columns: Column) -> Column:
    """True where every value is a number: not null, NaN or infinite. Spark calls NaN equal to NaN, hence the guard."""
    return all_of(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in columns)


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def within(a: list[Column], b: list[Column], tol: float, strict: bool = False) -> Column:
    """Per-axis closeness: a box, not a sphere."""
    return all_of((F.abs(p - q) < tol) if strict else (F.abs(p - q) <= tol) for p, q in zip(a, b, strict=True))


def cell(x: Column, size: float) -> Column:
    """Grid cell: mathematical floor, also for negatives."""
    return F.floor(x / F.lit(size)).cast("bigint")


def normalized_layer(layer: Column) -> Column:
    """Null, empty and the default names of any case are ``Layer0``; other names stay verbatim."""
    low = F.lower(layer)
    return F.when(layer.isNull() | (layer == "") | low.isin("layer0", "default", "untagged"), DEFAULT_LAYER).otherwise(layer)


def layer_role(name: Column) -> Column:
    return _first_rule(name, 1, "unknown")


def layer_role_rule(name: Column) -> Column:
    return _first_rule(name, 2, "name_no_match")


def _first_rule(name: Column, index: int, default: str) -> Column:
    out = F.when(name.isNull(), F.raise_error(F.lit("a layer name must not be null")))
    for rule in ROLE_RULES:
        out = out.when(name.rlike(f"(?i){rule[0]}"), rule[index])
    return out.otherwise(default)


def role_rank(role: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLE_ORDER)), role), F.lit(0)).cast("int")


def role_label(role: Column) -> Column:
    return F.initcap(role)


def visibility(visible: Column) -> tuple[Column, Column]:
    """(operational value, unknown): an unknown visibility counts as visible and is marked."""
    return F.coalesce(visible, F.lit(True)), visible.isNull()


def visibility_label(visible: Column, unknown: Column) -> Column:
    return F.when(unknown, "Visibility: unknown").when(visible, "Visible").otherwise("Off-screen")


def severity(issue_type: Column) -> Column:
    out = None
    for name, level in SEVERITY.items():
        out = F.when(issue_type == name, level) if out is None else out.when(issue_type == name, level)
    return out.otherwise("medium")


def canonical_level(value: Column) -> Column:
    return F.when(value.isin("low", "medium", "high"), value).otherwise("medium")


def sanitized(message: Column) -> Column:
    """Control characters go, but for tab, line feed and carriage return; null is empty."""
    return F.regexp_replace(F.coalesce(message, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def type_rank(issue_type: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, ISSUE_TYPES)), issue_type)
    return F.when(at > 0, at).otherwise(len(ISSUE_TYPES) + 1).cast("int")


def quantized(x: Column, tol: float) -> Column:
    """Nearest multiple of ``tol`` as an integer; halves away from zero."""
    return F.round(x * F.lit(1.0 / tol)).cast("bigint")


def geometry_key(s: list[Column], e: list[Column], layer: Column, tol: float = 1e-4) -> Column:
    """Orientation-free text key of an edge; the two quantized ends are put in order as strings."""
    text = lambda p, sep: F.concat_ws(sep, *[quantized(c, tol).cast("string") for c in p])
    # the order is that of the printed lists, so the separator is a comma and a blank inside brackets
    printed = lambda p: F.concat(F.lit("["), text(p, ", "), F.lit("]"))
    first = printed(s) <= printed(e)
    a, b = text(s, ","), text(e, ",")
    return F.concat(F.lit("geom|"), F.when(first, a).otherwise(b), F.lit("|"), F.when(first, b).otherwise(a), F.lit("|layer="), normalized_layer(layer))


def pid_path_text(path: Column, sep: str = ".") -> Column:
    return F.array_join(path.cast("array<string>"), sep)


def instance_path_text(labels: Column) -> Column:
    """Labels of the containers above, for display only: identity rests on pid paths."""
    return F.array_join(labels, " > ")


def container_label(kind: Column, definition_name: Column, name: Column, node_id: Column) -> Column:
    """Kind and name of a container; instances carry their number in hexadecimal too, as several share a name.

    The name is the definition's, else the container's own, else the number; empty names count as none.
    """
    number = F.concat(F.lit("0x"), F.lower(F.hex(node_id)))
    shown = F.coalesce(F.nullif(definition_name, F.lit("")), F.nullif(name, F.lit("")), number)
    return F.when(kind == "instance", F.concat(F.lit("ComponentInstance:"), shown, F.lit("#"), number)).otherwise(F.concat(F.lit("Group:"), shown))


def occurrence_id(path: Column, instance_path: Column, complete: Column, record_id: Column, kind: str = "edge") -> Column:
    """Identity of an occurrence within a snapshot: by pid path, else by labels, else by the record's own id."""
    quality = F.when(complete, "occ-").otherwise("transient-occ-")
    return (
        F.when(F.size(path) > 0, F.concat(quality, pid_path_text(path, ">")))
        .when(F.size(instance_path) > 0, F.concat(quality, F.lit("ipath-"), F.array_join(instance_path, ">")))
        .otherwise(F.concat(F.lit(f"transient-occ-{kind}-"), record_id.cast("string")))
    )


def path_of_occurrence(occ: Column) -> Column:
    """The pid path an occurrence id spells, without parts that aren't numbers; null if nothing is left."""
    rest = F.regexp_extract(occ, r"^(?:occ-|transient-occ-)(?:ipath-)?(.*)$", 1)
    parts = F.array_compact(F.transform(F.split(rest, ">"), lambda p: p.try_cast("bigint")))
    return F.when(occ.rlike("^(occ-|transient-occ-)") & (F.size(parts) > 0), parts)


def derived_id(edge_id: Column, path: Column, persistent_id: Column) -> Column:
    fragment = (
        F.when(F.size(path) > 0, pid_path_text(path, "-"))
        .when(persistent_id.isNotNull(), F.concat(F.lit("pid"), persistent_id.cast("string")))
        .otherwise(F.concat(F.lit("rec"), edge_id.cast("string")))
    )
    return F.concat(F.lit("der-edge-"), edge_id.cast("string"), F.lit("-"), fragment)


def locator_target(path: Column, entity_id: Column, nested: Column, complete: Column) -> tuple[Column, Column]:
    """(kind, reason) of the entity an issue's source token points at."""
    root_by_id = ~complete & ~nested & entity_id.isNotNull()
    kind = F.when(complete & ~nested, "inst_path_leaf").when(complete & nested, "inst_path_root").when(root_by_id, "entity_id").otherwise("skip")
    reason = F.when(
        kind == "skip",
        F.when(nested & (F.size(path) > 0), "incomplete-nested-partial-leaf").when(nested, "incomplete-nested-partial-ancestry").otherwise("fully-missing"),
    )
    return kind, reason


def display_length(value: Column) -> Column:
    """Four decimals and the unit. Digits come from integer arithmetic, so every engine prints the same."""
    scaled = F.round(F.abs(value) * 10000).cast("bigint")
    text = F.concat(((scaled - scaled % 10000) / 10000).cast("bigint").cast("string"), F.lit("."), F.lpad((scaled % 10000).cast("string"), 4, "0"), F.lit(" inch"))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def structural_depth(active_slots: Column, ancestors: Column) -> Column:
    """Containers above a leaf: slots of the edit context, missing ones too, and ancestors."""
    return (F.size(active_slots) + F.size(ancestors)).cast("int")


def structural_path(ancestors: Column, leaf: Column) -> tuple[Column, Column]:
    """(path, complete): missing ancestors are left out of the path, and make it incomplete like a missing leaf."""
    complete = F.forall(ancestors, lambda a: a.isNotNull()) & leaf.isNotNull()
    path = F.concat(F.array_compact(ancestors), F.when(leaf.isNotNull(), F.array(leaf)).otherwise(F.array().cast("array<bigint>")))
    return path, complete


def major_version(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"^\s*(\d+)", 1), F.lit("")).cast("int")
