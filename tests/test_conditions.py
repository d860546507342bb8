"""Conditions of a plan as JSON payloads: normal forms, the first fault in order."""

import json

from terrafold.operators.register import checked_conditions

CASES = [
    ({"city": "  Radom ", "max_building_height": "9,5", "max_storeys_above": "+3", "services_allowed": True, "landUses": [{"symbol": " MN ", "area": "12,345"}, {"symbol": "U", "area": 3}]}, {"city": "Radom", "max_building_height": "9.50", "max_storeys_above": "3", "services_allowed": "true", "land_uses": "MN=12.34;U=3.00"}),
    ({"street": None, "max_ridge_height": "", "nuisance_services_forbidden": None, "city": " ", "parcelAreaTotal": 7, "unknown": 1}, {"street": None, "max_ridge_height": None, "nuisance_services_forbidden": None, "city": None, "parcel_area_total": "7.00"}),
    ({"plot_number": "x" * 256}, ("FIELD_TOO_LONG", "plot_number")), ({"land_use_allowed": "x" * 2000}, {"land_use_allowed": "x" * 2000}), ({"land_use_allowed": "x" * 2001}, ("FIELD_TOO_LONG", "land_use_allowed")),
    ({"services_allowed": "true", "max_building_height": "-1"}, ("INVALID_BOOLEAN", "services_allowed")), ({"max_building_height": " "}, ("INVALID_NUMBER", "max_building_height")), ({"max_building_height": "-0,5"}, ("NEGATIVE_NUMBER", "max_building_height")),
    ({"roof_slope_max_deg": "90,01"}, ("VALUE_OUT_OF_RANGE", "roof_slope_max_deg")), ({"min_biologically_active_share": 100}, {"min_biologically_active_share": "100.00"}), ({"min_biologically_active_share": "101"}, ("VALUE_OUT_OF_RANGE", "min_biologically_active_share")),
    ({"max_storeys_below": "2.5"}, ("INVALID_INTEGER", "max_storeys_below")), ({"max_storeys_below": -1}, ("NEGATIVE_INTEGER", "max_storeys_below")),
    ({"land_uses": "MN"}, ("INVALID_LAND_USES", "land_uses")), ({"land_uses": [{"symbol": "A", "area": 1}, 5]}, ("INVALID_LAND_USE_ITEM", "1")), ({"land_uses": [{"symbol": " ", "area": 1}]}, ("INVALID_LAND_USE_SYMBOL", "0")),
    ({"land_uses": [{"symbol": "A" * 65, "area": 1}]}, ("FIELD_TOO_LONG", "landUses[0].symbol")), ({"land_uses": [{"symbol": "A"}]}, ("INVALID_NUMBER", "landUses[0].area")), ({"land_uses": [{"symbol": "A", "area": "-1"}]}, ("NEGATIVE_NUMBER", "landUses[0].area")),
    ({"land_uses": []}, {"land_uses": ""}), ({}, {}),
]


def test_conditions(spark):
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(CASES)] + [(100, "no json"), (101, None), (102, "[1]")]
    got = {r["id"]: r for r in checked_conditions(spark.createDataFrame(rows, "id long, payload string")).collect()}
    for i, (_, want) in enumerate(CASES):
        r = got[i]
        assert ((r["error_code"], r["error_field"]) if isinstance(want, tuple) else r["accepted"]) == want, CASES[i]
        assert (r["accepted"] is None) == isinstance(want, tuple) == (r["error_code"] is not None)
    assert {got[i]["error_code"] for i in (100, 101, 102)} == {"INVALID_JSON"}
