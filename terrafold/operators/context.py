"""Site contexts: the layer catalogue, import plans, what an import brought, objects of note and the nested export.

The catalogue is a fixed list, so plans and statuses are expressions over a literal array beside each context's row; only
the features are grouped, and nothing is crossed with the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layer key, label, group, preferred source, geometry, whether it can be derived; in the order of display.
LAYERS = [
    ("plot_boundary", "Granica działki", "Granice i obszary bazowe", "parcel_provider", "Polygon", False),
    ("land_use_boundary", "Granica przeznaczenia terenu", "Granice i obszary bazowe", "planning_docs", "Polygon", False),
    ("site_boundary", "Obszar opracowania", "Granice i obszary bazowe", "derived", "Polygon", True),
    ("building_setback_line", "Linia odsunięcia zabudowy", "Ograniczenia zabudowy", "planning_docs", "LineString", False),
    ("mandatory_building_line", "Obowiązująca linia zabudowy", "Ograniczenia zabudowy", "planning_docs", "LineString", False),
    ("offset_from_boundary_zone", "Strefa odsunięcia od granicy", "Ograniczenia zabudowy", "derived", "Polygon", True),
    ("no_build_zone", "Strefa zakazu zabudowy", "Ograniczenia zabudowy", "planning_docs", "Polygon", False),
    ("limited_build_zone", "Strefa ograniczonej zabudowy", "Ograniczenia zabudowy", "planning_docs", "Polygon", False),
    ("road_edge", "Krawędź drogi", "Drogi i dostęp", "reference", "LineString", False),
    ("road_centerline", "Oś drogi", "Drogi i dostęp", "reference", "LineString", False),
    ("road_right_of_way", "Pas drogowy", "Drogi i dostęp", "reference", "Polygon", False),
    ("access_point", "Punkt dostępu", "Drogi i dostęp", "derived", "Point", True),
    ("driveway", "Dojazd", "Drogi i dostęp", "derived", "LineString", True),
    ("fire_access_route", "Droga pożarowa", "Drogi i dostęp", "derived", "LineString", True),
    ("parking_zone", "Strefa parkingowa", "Drogi i dostęp", "derived", "Polygon", True),
    ("elevation_point", "Punkt wysokościowy", "Teren i wysokości", "reference", "Point", False),
    ("contour_line", "Warstwica", "Teren i wysokości", "reference", "LineString", False),
    ("terrain_break_line", "Linia załamania terenu", "Teren i wysokości", "reference", "LineString", False),
    ("slope_zone", "Strefa spadku", "Teren i wysokości", "derived", "Polygon", True),
    ("embankment", "Nasyp", "Teren i wysokości", "reference", "LineString", False),
    ("cut_slope", "Wykop / skarpa", "Teren i wysokości", "reference", "LineString", False),
    ("retaining_wall", "Mur oporowy", "Teren i wysokości", "reference", "LineString", False),
    ("existing_building", "Istniejący budynek", "Istniejące obiekty", "reference", "Polygon", False),
    ("adjacent_building", "Budynek sąsiedni", "Istniejące obiekty", "reference", "Polygon", False),
    ("outbuilding", "Budynek pomocniczy", "Istniejące obiekty", "reference", "Polygon", False),
    ("canopy_structure", "Wiata", "Istniejące obiekty", "reference", "Polygon", False),
    ("fence_line", "Ogrodzenie", "Istniejące obiekty", "reference", "LineString", False),
    ("gate", "Brama", "Istniejące obiekty", "reference", "Point", False),
    ("water_pipe", "Sieć wodociągowa", "Sieci uzbrojenia", "reference", "LineString", False),
    ("sanitary_sewer", "Kanalizacja sanitarna", "Sieci uzbrojenia", "reference", "LineString", False),
    ("storm_sewer", "Kanalizacja deszczowa", "Sieci uzbrojenia", "reference", "LineString", False),
    ("gas_pipe", "Gazociąg", "Sieci uzbrojenia", "reference", "LineString", False),
    ("power_line_underground", "Kabel energetyczny podziemny", "Sieci uzbrojenia", "reference", "LineString", False),
    ("power_line_overhead", "Linia energetyczna napowietrzna", "Sieci uzbrojenia", "reference", "LineString", False),
    ("telecom_line", "Sieć teletechniczna", "Sieci uzbrojenia", "reference", "LineString", False),
    ("utility_connection", "Przyłącze", "Sieci uzbrojenia", "reference", "LineString", False),
    ("utility_node", "Obiekt punktowy sieci", "Sieci uzbrojenia", "reference", "Point", False),
    ("transformer_station", "Stacja transformatorowa", "Sieci uzbrojenia", "reference", "Polygon", False),
    ("utility_protection_zone", "Strefa ochronna sieci", "Sieci uzbrojenia", "derived", "Polygon", True),
    ("watercourse", "Ciek wodny", "Woda i odwodnienie", "reference", "LineString", False),
    ("drainage_ditch", "Rów odwadniający", "Woda i odwodnienie", "reference", "LineString", False),
    ("pond", "Zbiornik wodny", "Woda i odwodnienie", "reference", "Polygon", False),
    ("flood_zone", "Strefa zalewowa", "Woda i odwodnienie", "reference", "Polygon", False),
    ("soakaway_zone", "Strefa retencji", "Woda i odwodnienie", "derived", "Polygon", True),
    ("tree", "Drzewo", "Zieleń", "reference", "Point", False),
    ("tree_canopy", "Korona drzewa", "Zieleń", "reference", "Polygon", False),
    ("root_protection_zone", "Strefa ochrony korzeni", "Zieleń", "derived", "Polygon", True),
    ("shrub_area", "Krzewy", "Zieleń", "reference", "Polygon", False),
    ("protected_tree", "Drzewo chronione", "Zieleń", "reference", "Point", False),
    ("biologically_active_area", "Powierzchnia biologicznie czynna", "Zieleń", "derived", "Polygon", True),
    ("forest_boundary", "Granica lasu", "Zieleń", "reference", "LineString", False),
    ("conservation_zone", "Strefa ochrony konserwatorskiej", "Strefy ochronne", "reference", "Polygon", False),
    ("environmental_protection_zone", "Strefa ochrony środowiskowej", "Strefy ochronne", "reference", "Polygon", False),
    ("noise_impact_zone", "Strefa hałasu", "Strefy ochronne", "derived", "Polygon", True),
    ("height_limit_zone", "Strefa ograniczenia wysokości", "Strefy ochronne", "planning_docs", "Polygon", False),
    ("special_restriction_zone", "Strefa szczególnych ograniczeń", "Strefy ochronne", "planning_docs", "Polygon", False),
    ("buildable_area", "Obszar możliwej zabudowy", "Wynik analizy", "analysis", "Polygon", True),
    ("max_building_envelope", "Maksymalna obwiednia zabudowy", "Wynik analizy", "analysis", "Polygon", True),
    ("preferred_building_zone", "Preferowana strefa zabudowy", "Wynik analizy", "analysis", "Polygon", True),
    ("building_candidate", "Kandydat zabudowy", "Wynik analizy", "analysis", "Polygon", True),
]
#: Layers that are always there, that are imported, and that are drawn by hand.
CORE = ("plot_boundary", "site_boundary")
IMPORTED = ("land_use_boundary", "road_edge", "road_centerline", "road_right_of_way", "elevation_point", "contour_line", "existing_building", "fence_line", "water_pipe", "sanitary_sewer", "storm_sewer", "gas_pipe", "power_line_underground", "power_line_overhead", "telecom_line", "utility_node", "transformer_station", "watercourse", "drainage_ditch", "pond", "flood_zone", "tree", "shrub_area", "forest_boundary", "conservation_zone", "environmental_protection_zone", "noise_impact_zone", "height_limit_zone", "special_restriction_zone")
BY_HAND = ("building_setback_line", "mandatory_building_line", "no_build_zone", "access_point", "driveway", "fire_access_route", "parking_zone", "terrain_break_line", "slope_zone", "embankment", "cut_slope", "retaining_wall", "outbuilding", "canopy_structure", "gate", "utility_connection", "soakaway_zone", "protected_tree")
#: Layers whose objects always matter, networks, and what a source type counts as.
OF_NOTE = ("adjacent_building", "no_build_zone", "flood_zone", "utility_protection_zone", "limited_build_zone")
NETWORKS = ("water_pipe", "sanitary_sewer", "storm_sewer", "gas_pipe", "power_line_underground", "power_line_overhead", "telecom_line", "utility_connection", "utility_node", "transformer_station")
SOURCE_KINDS = {"analysis": "derived", "derived": "derived", "reference": "imported", "planning_docs": "imported", "parcel_provider": "imported", "geoportal": "imported"}
#: strategy: the status that a layer gets by it.
STRATEGIES = {"core_geometry": "loaded", "try_direct_import": "loaded", "manual_placeholder": "manual_placeholder", "derive_later": "derived", "create_empty": "empty", "source_unavailable": "unavailable"}


def strategy(key: str, derivable: bool, selected: tuple[str, ...]) -> str:
    """The first that holds: always there, imported, by hand, derivable, not selected, else without a source."""
    tests = [(key in CORE, "core_geometry"), (key in IMPORTED, "try_direct_import"), (key in BY_HAND, "manual_placeholder"), (derivable, "derive_later"), (bool(selected) and key not in selected, "create_empty")]
    return next((name for test, name in tests if test), "source_unavailable")


def catalogue(spark: SparkSession, selected: tuple[str, ...] = ()) -> DataFrame:
    """layer_key, label, layer_group, source_type, geometry_type, sort_order, strategy, target_status, scope of every layer."""
    rows = [(key, label, group, source, shape, i, (how := strategy(key, derivable, selected)), STRATEGIES[how], "plot_boundary" if key in ("plot_boundary", "land_use_boundary") else "site_boundary") for i, (key, label, group, source, shape, derivable) in enumerate(LAYERS)]
    return spark.createDataFrame(rows, "layer_key string, label string, layer_group string, source_type string, geometry_type string, sort_order int, strategy string, target_status string, scope string")


def enriched(features: DataFrame, layers: DataFrame) -> DataFrame:
    """features with their layer's label, group, source and order (layers: the fixed list, broadcast)."""
    return features.join(F.broadcast(layers.select("layer_key", "label", "layer_group", "source_type", "sort_order")), "layer_key")


def source_kind(status: Column, source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SOURCE_KINDS.items() for x in pair))
    return F.when(status == "manual_placeholder", "placeholder").when(status == "derived", "derived").otherwise(F.coalesce(known[source], F.lit("imported")))


def tagged(objects: DataFrame) -> DataFrame:
    """objects (layer_key, within_plot, intersects_plot) with plot_relation, collision (networks only) and tree_context (trees only)."""
    relation = F.when(F.col("within_plot"), "on_plot").when(F.col("intersects_plot"), "collision").otherwise("site_context")
    return objects.withColumns({
        "plot_relation": relation,
        "collision": F.when(F.col("layer_key").isin(*NETWORKS), F.coalesce("intersects_plot", F.lit(False))),
        "tree_context": F.when(F.col("layer_key") == "tree", F.when(F.col("within_plot"), "plot").otherwise("neighborhood")),
    })


def of_note(objects: DataFrame) -> DataFrame:
    """Tagged objects on or across the plot, in collision, or of layers that always matter."""
    return objects.where(F.coalesce("within_plot", F.lit(False)) | F.coalesce("intersects_plot", F.lit(False)) | F.coalesce("collision", F.lit(False)) | F.col("layer_key").isin(*OF_NOTE))


def import_summary(found: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
    """context_id, status, loaded, empty, unavailable, errors (layer keys in catalogue order, comma-joined), n_objects.

    found: context_id, layer_key, n (features), n_bad (those without geometry), a row for each layer that a source answered.
    Imported layers without a row have no source. All features bad: an error; some: loaded, with an error noted.
    """
    per = found.groupBy("context_id").agg(F.map_from_entries(F.collect_list(F.struct("layer_key", F.struct("n", "n_bad").alias("v")))).alias("got"))  # at most a row a catalogue layer
    plan = F.array(*(F.struct(F.lit(key).alias("key"), F.lit(strategy(key, derivable, selected)).alias("how")) for key, _, _, _, _, derivable in LAYERS))
    asked = lambda x: (x["how"] == "try_direct_import") | (x["key"] == "adjacent_building")

    def state(x: Column) -> Column:
        v = F.col("got")[x["key"]]
        imported = F.when(v.isNull(), "unavailable").when(v["n"] == 0, "empty").when(v["n_bad"] == v["n"], "error").otherwise("loaded")
        planned = F.create_map(*(F.lit(y) for pair in STRATEGIES.items() for y in pair))[x["how"]]
        return F.struct(x["key"].alias("key"), F.when(x["how"] == "core_geometry", "loaded").when(asked(x), imported).otherwise(planned).alias("state"), (asked(x) & F.coalesce(v["n_bad"] > 0, F.lit(False))).alias("bad"), F.when(x["how"] == "core_geometry", F.lit(1).cast("long")).when(asked(x), F.coalesce(v["n"] - v["n_bad"], F.lit(0))).otherwise(0).alias("n"))

    told = per.select("context_id", F.transform(plan, state).alias("layers"))
    keys = lambda test: F.array_join(F.transform(F.filter("layers", test), lambda x: x["key"]), ",")
    loaded, empty, unavailable, errors = (keys(test) for test in (lambda x: x["state"] == "loaded", lambda x: x["state"] == "empty", lambda x: x["state"] == "unavailable", lambda x: x["bad"]))
    out = told.select("context_id", loaded.alias("loaded"), empty.alias("empty"), unavailable.alias("unavailable"), errors.alias("errors"), F.aggregate("layers", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_objects"))
    status = F.when((F.col("loaded") == "") & (F.col("empty") != ""), "empty").when((F.col("loaded") == "") & (F.col("unavailable") == ""), "derived").when((F.col("unavailable") != "") | (F.col("errors") != ""), F.when(F.col("loaded") == "", "unavailable").otherwise("error")).otherwise("loaded")
    return out.withColumn("status", status)


def semantic_export(objects: DataFrame, analysis: DataFrame) -> DataFrame:
    """context_id, json: layers with their features' numbers, objects of note and the buildable area, nested.

    objects: tagged, with context_id, feature_id and geom_type; analysis: context_id, buildable_area. A context's export is
    one value, as its reader takes it; objects of a context are bounded by its site.
    """
    layers = objects.groupBy("context_id", "layer_key").agg(F.count("*").alias("featureCount"), F.min("geom_type").alias("geometryType"))
    per_layer = layers.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct(F.col("layer_key").alias("layerKey"), "geometryType", "featureCount"))).alias("layers"))
    per_object = of_note(objects).groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").alias("id"), F.col("layer_key").alias("layerKey"), F.col("plot_relation").alias("plotRelation")))).alias("importantObjects"))
    summary = F.struct(F.col("buildable_area").cast("long").alias("buildableArea"), (F.col("buildable_area") > 0).alias("hasBuildableArea"))
    joined = per_layer.join(per_object.hint("merge"), "context_id", "left").join(analysis.hint("merge"), "context_id", "left")
    none = F.array().cast("array<struct<id: bigint, layerKey: string, plotRelation: string>>")
    return joined.select("context_id", F.to_json(F.struct("layers", F.coalesce("importantObjects", none).alias("importantObjects"), summary.alias("analysisSummary"))).alias("json"))
