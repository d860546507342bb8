"""Projects, costs, versions, histories and upserts: relational operators over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_of(projects: DataFrame, user_id: Column | None = None) -> DataFrame:
    """Rows that aren't deleted, of one tenant where one is given."""
    kept = projects.where("deleted_at IS NULL")
    return kept if user_id is None else kept.where(F.col("user_id") == user_id)


def cost_rollup(items: DataFrame) -> DataFrame:
    """Net and gross (equal) of each project's items: the sum of quantity times unit price, to the cent."""
    total = F.sum((F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)"))
    return items.groupBy("project_id").agg(F.count("*").alias("n_items"), total.alias("net"), total.alias("gross"))


def overview(users: DataFrame, projects: DataFrame) -> DataFrame:
    """One row: users, administrators, projects that aren't deleted, those of them in progress."""
    people = users.agg(F.count("*").alias("users"), F.count_if("is_admin").alias("admins"))
    work = projects.agg(F.count_if(F.col("deleted_at").isNull()).alias("projects"), F.count_if(F.col("deleted_at").isNull() & (F.col("status") == "o")).alias("active"))
    return people.crossJoin(F.broadcast(work))  # one row each


def latest(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the order given."""
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank_") <= k).drop("rank_")


def versions(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with version (1 on, by the order) and is_current."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    count = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("version", number).withColumn("is_current", number == count)


def history(edits: DataFrame) -> DataFrame:
    """Each edit with the value before it of the same parcel and field, and whether it changed it."""
    w = Window.partitionBy("parcel_id", "field_key").orderBy("ts", "id")
    return edits.withColumn("old_value", F.lag("value").over(w)).withColumn("changed", ~F.col("old_value").eqNullSafe(F.col("value")))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with new rows over those of equal keys; of several new rows the one of the highest order counts."""
    both = stored.withColumn("from_", F.lit(0)).unionByName(new.withColumn("from_", F.lit(1)))
    return latest(both, keys, [F.desc("from_"), F.desc(order)]).drop("from_")


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, old_value, new_value where a trimmed new value (empty: null) differs from the stored one; missing sides are null."""
    put = new.withColumn("value", F.nullif(F.trim("value"), F.lit("")))
    a, b = old.withColumnRenamed("value", "old_value"), put.withColumnRenamed("value", "new_value")
    return a.join(b.hint("merge"), keys, "full").where("NOT (old_value <=> new_value)")


def cascade(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """rows whose parent isn't deleted."""
    return rows.join(deletes.select(key).distinct().hint("merge"), key, "left_anti")


def rule_map(edits: DataFrame) -> DataFrame:
    """parcel_id, rules, provenance: each field's last value by id, and the id it came from."""
    last = edits.where("field_key <> 'parcelReference' AND value IS NOT NULL").groupBy("parcel_id", "field_key").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_key", F.col(c).cast("string"))))).alias
    return last.groupBy("parcel_id").agg(entries("value")("rules"), entries("id")("provenance"))


def single_parcel(references: DataFrame) -> DataFrame:
    """doc_id, parcel: the one parcel that a document refers to, null where it refers to several."""
    return references.groupBy("doc_id").agg(F.when(F.count_distinct("parcel") == 1, F.min("parcel")).alias("parcel"))


def pad_missing(fields: DataFrame, keys: DataFrame, ids: str = "doc_id") -> DataFrame:
    """fields with a row REQUIRES_REVIEW for each catalogue key (broadcast: a fixed list) that an id lacks."""
    every = fields.select(ids).distinct().crossJoin(F.broadcast(keys))
    missing = every.join(fields.select(ids, "field_key").hint("merge"), [ids, "field_key"], "left_anti")
    return fields.unionByName(missing.withColumn("status", F.lit("REQUIRES_REVIEW")), allowMissingColumns=True)


def validate_conditions(rows: DataFrame) -> DataFrame:
    """rows (id, label, height, slope, share, storeys as text) typed, with the first error's code in the fields' order."""
    amount = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(12,2)")
    given = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(None).cast("string")).isNotNull()
    code = F.lit(None).cast("string")
    tests = [
        (F.length(F.trim("label")) > 255, "LABEL_TOO_LONG"),
        (given("height") & amount("height").isNull(), "HEIGHT_INVALID"), (amount("height") < 0, "HEIGHT_NEGATIVE"),
        (given("slope") & amount("slope").isNull(), "SLOPE_INVALID"), ((amount("slope") < 0) | (amount("slope") > 90), "SLOPE_RANGE"),
        (given("share") & amount("share").isNull(), "SHARE_INVALID"), ((amount("share") < 0) | (amount("share") > 100), "SHARE_RANGE"),
        (given("storeys") & ~F.trim("storeys").rlike("^[0-9]+$"), "STOREYS_INVALID"),
    ]
    code = F.coalesce(*(F.when(test, F.lit(name)) for test, name in tests))
    return rows.select("id", F.trim("label").alias("label"), *(amount(c).alias(c) for c in ("height", "slope", "share")), F.trim("storeys").try_cast("int").alias("storeys"), code.alias("error_code"))


#: A plan's conditions in the order in which they are checked, and what each holds: a text of at most so many characters, a
#: strict boolean, an amount, a slope, a share, a count or a list of land uses.
CONDITIONS = [
    ("plot_number", 255), ("cadastral_district", 255), ("street", 255), ("city", 255), ("land_use_primary", 2000), ("land_use_allowed", 2000), ("land_use_forbidden", 2000),
    ("services_allowed", "boolean"), ("nuisance_services_forbidden", "boolean"), ("land_uses", "land_uses"), ("parcel_area_total", "amount"),
    ("max_building_height", "amount"), ("max_storeys_above", "count"), ("max_storeys_below", "count"), ("max_ridge_height", "amount"), ("max_eaves_height", "amount"),
    ("min_building_intensity", "amount"), ("max_building_intensity", "amount"), ("max_building_coverage", "amount"), ("min_biologically_active_share", "share"),
    ("min_front_elevation_width", "amount"), ("max_front_elevation_width", "amount"), ("roof_type_allowed", 2000), ("roof_slope_min_deg", "slope"), ("roof_slope_max_deg", "slope"),
    ("ridge_direction_required", 2000), ("roof_cover_material_limits", 2000), ("facade_roof_color_limits", 2000), ("parking_required_info", 2000),
    ("parking_spaces_per_unit", "amount"), ("parking_spaces_per_100sqm_services", "amount"), ("parking_disability_requirement", 2000),
    ("conservation_protection_zone", 2000), ("nature_protection_zone", 2000), ("noise_emission_limits", 2000),
]
#: Other names of fields, the longest land-use symbol, and the most that slopes and shares may be.
ALIASES = {"land_uses": "landUses", "parcel_area_total": "parcelAreaTotal"}
SYMBOL, MOST = 64, {"slope": 90, "share": 100}


def checked_conditions(rows: DataFrame) -> DataFrame:
    """rows (id, payload: a JSON object) with accepted (each given field's normal form, as text), error_code and error_field.

    The first field in the order of CONDITIONS that is wrong gives the error; such a row's accepted is null. Null fields are cleared (null),
    fields that aren't given aren't told. Numbers may have a comma, are rounded to cents (half to even) and not negative; an empty text is no
    number, and no fault either. Booleans must be JSON's own. A payload that is no JSON object has the error INVALID_JSON.
    """
    v = F.col("v_")
    told = rows.withColumn("v_", F.try_parse_json("payload"))
    at = lambda field, kind="string": F.coalesce(*(F.try_variant_get(v, f"$.{name}", kind) for name in (field, ALIASES.get(field)) if name))
    number = lambda c: F.bround(F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("decimal(28,10)"), 2)
    fault = lambda test, code, field: F.when(test, F.struct(F.lit(code).alias("code"), (F.lit(field) if isinstance(field, str) else field).alias("field")))

    def amount_faults(c: Column, field) -> list[Column]:
        return [fault(c.isNotNull() & (c != "") & number(c).isNull(), "INVALID_NUMBER", field), fault(number(c) < 0, "NEGATIVE_NUMBER", field)]

    def use_faults(item: Column, i: Column) -> Column:
        symbol, area = (F.try_variant_get(item, f"$.{k}", "string") for k in ("symbol", "area"))
        place = i.cast("string")
        name = lambda k: F.concat(F.lit("landUses["), place, F.lit(f"].{k}"))
        return F.coalesce(
            fault(~F.startswith(F.schema_of_variant(item), F.lit("OBJECT")), "INVALID_LAND_USE_ITEM", place), fault(F.coalesce(F.trim(symbol), F.lit("")) == "", "INVALID_LAND_USE_SYMBOL", place),
            fault(F.length(F.trim(symbol)) > SYMBOL, "FIELD_TOO_LONG", name("symbol")), *amount_faults(area, name("area")), fault(F.coalesce(area, F.lit("")) == "", "INVALID_NUMBER", name("area")),
        )

    faults, normal = [], []
    for field, kind in CONDITIONS:
        c = at(field)
        if isinstance(kind, int):
            faults.append(fault(F.length(F.trim(c)) > kind, "FIELD_TOO_LONG", field))
            value = F.nullif(F.trim(c), F.lit(""))
        elif kind == "boolean":
            faults.append(fault(c.isNotNull() & (F.schema_of_variant(at(field, "variant")) != "BOOLEAN"), "INVALID_BOOLEAN", field))
            value = c
        elif kind == "count":
            faults += [fault((c != "") & ~F.trim(c).rlike("^[+-]?[0-9]+$"), "INVALID_INTEGER", field), fault(F.trim(c).try_cast("bigint") < 0, "NEGATIVE_INTEGER", field)]
            value = F.trim(c).try_cast("bigint").cast("string")
        elif kind == "land_uses":
            list_ = at(field, "array<variant>")
            faults.append(fault(c.isNotNull() & ~F.startswith(F.schema_of_variant(at(field, "variant")), F.lit("ARRAY")), "INVALID_LAND_USES", field))
            faults.append(F.get(F.filter(F.transform(list_, use_faults), lambda x: x.isNotNull()), F.lit(0)))
            one = lambda x: F.concat_ws("=", F.trim(F.try_variant_get(x, "$.symbol", "string")), number(F.try_variant_get(x, "$.area", "string")).cast("string"))
            value = F.array_join(F.transform(list_, one), ";")
        else:
            faults += amount_faults(c, field)
            if kind in MOST:
                faults.append(fault(number(c) > MOST[kind], "VALUE_OUT_OF_RANGE", field))
            value = number(c).cast("string")
        given = F.exists(F.json_object_keys("payload"), lambda k: k.isin(field, ALIASES.get(field, field)))  # noqa: B023
        normal.append(F.when(given, F.struct(F.lit(field).alias("key"), value.alias("value"))))
    whole = fault(F.json_object_keys("payload").isNull(), "INVALID_JSON", "payload")
    out = told.withColumn("fault_", F.coalesce(whole, *faults))
    accepted = F.when(F.col("fault_").isNull(), F.map_from_entries(F.array_compact(F.array(*normal))))
    return out.select("id", accepted.alias("accepted"), F.col("fault_.code").alias("error_code"), F.col("fault_.field").alias("error_field"))


def replace_land_uses(stored: DataFrame, items: DataFrame) -> DataFrame:
    """parent, symbol, area: a parent's new items if all are valid (a symbol of capitals, digits and dashes, up to 64; no negative area), else its stored ones."""
    valid = F.upper(F.regexp_replace("symbol", r"\s+", "")).rlike("^[A-Z0-9.-]{1,64}$") & (F.col("area") >= 0)
    told = items.groupBy("parent").agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("ok"))
    good = told.where("ok").select("parent")
    new = items.join(good.hint("merge"), "parent", "left_semi").select("parent", F.upper(F.regexp_replace("symbol", r"\s+", "")).alias("symbol"), "area")
    return stored.join(good.hint("merge"), "parent", "left_anti").select("parent", "symbol", "area").unionByName(new)


def default_children(parents: DataFrame, children: DataFrame, label: Column) -> DataFrame:
    """A child row, labelled (at most 120 characters), for each parent that has none."""
    return parents.join(children.select("project_id").distinct().hint("merge"), "project_id", "left_anti").select("project_id", F.substr(label, F.lit(1), F.lit(120)).alias("label"))


def label_conflicts(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """rows with error_code CONFLICT on all but the first of equal keys."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("error_code", F.when(number > 1, "CONFLICT"))


def nested_plots(projects: DataFrame, plots: DataFrame, parameters: DataFrame) -> DataFrame:
    """project_id, plots: each project's plots with their parameters, ordered by id and key."""
    per = parameters.groupBy("plot_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("parameters"))
    full = plots.join(per.hint("merge"), "plot_id", "left").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("plot_id", "parameters"))).alias("plots"))
    return projects.select("project_id").join(full.hint("merge"), "project_id", "left")
