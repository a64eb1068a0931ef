"""Summaries: strict means (Q10), complete grids with NULL keys (A5, Q17), log matrix."""

import math

from setscore.functions import labels as L
from setscore.operators import summaries as S


def test_strict_mean_propagates_missing(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", 2.0), ("h", 4.0)], "k string, v double")
    loose = {r["k"]: r["m"] for r in S.group_mean(df, ["k"], "v", "m").collect()}
    strict = {r["k"]: r["m"] for r in S.group_mean(df, ["k"], "v", "m", strict=True).collect()}
    assert loose == {"g": 1.0, "h": 3.0}
    assert strict == {"g": None, "h": 3.0}


def test_complete_grid_fills_and_keeps_null_key(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("B", None, 2.0), ("B", "x", math.e)],
                               "gene string, grp string, mean_exp double")
    got = {(r["gene"], r["grp"]): r["log_exp"] for r in S.log_matrix(df, "gene", "grp").collect()}
    assert got == {("A", "x"): 0.0, ("A", None): 0.0, ("B", None): math.log(2.0), ("B", "x"): 1.0}


def test_mouse_labels_never_patient_specific(spark):
    units = [f"{ct}_S1_3" for ct in ("B-cell", "CAF", "DC", "EC", "Malignant", "Monocyte/macrophage",
                                      "Pericyte", "T/NKcell", "Unknown")]
    df = L.mouse_unit_labels(spark.createDataFrame([(u,) for u in units], "unit string"))
    assert S.drop_patient_specific(df).count() == len(units)        # Q16: F6 keeps every mouse row
    labels = {r["unit"]: r["cell_type"] for r in df.collect()}
    assert labels["Unknown_S1_3"] is None and labels["Monocyte/macrophage_S1_3"] == "Monocyte/macrophage"


def test_box_outliers(spark):
    rows = [("a", float(i), f"u{i}") for i in range(1, 10)] + [("a", 100.0, "far"), ("a", None, "none"), (None, 1.0, "n1"), (None, 1.0, "n2"), (None, 1.0, "n3"), (None, -5.0, "low")]
    df = spark.createDataFrame(rows, "grp string, v double, unit string")
    # quartiles of 1 ... 9, 100 are 3.25 and 7.75; three equal values have no spread, and -5 pulls q1 to -0.5
    assert sorted(r.unit for r in S.box_outliers(df, ["grp"], "v").collect()) == ["far", "low"]
    counts = {r.grp: r.n_outliers for r in S.box_stats(df, ["grp"], "v").collect()}
    assert counts == {"a": 1, None: 1} and S.box_outliers(df, ["grp"], "v").columns == df.columns
