"""Label functions: golden cases (FIXTURES.md §3) and quirks Q3-Q7, Q9."""

import math

from pyspark.sql import functions as F

from setscore.functions import labels as L


def _one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).collect()[0]["y"]


def test_human_name_golden(spark):
    u = "Mesenchymallike_NonResponders_BT_scr_GC3_57"
    assert _one(spark, lambda c: L.sample_of(c, 3, 2), u) == "scr"
    assert _one(spark, lambda c: L.sample_of(c, 2, 2), u) == "BT_scr"
    assert _one(spark, L.response_of, u) == "Non Responders"
    assert _one(spark, L.timepoint_of, u) == "BT"
    assert _one(spark, L.human_cell_type, u) == "Mesenchymal like"
    assert _one(spark, L.sample_cell_type, u) == "Mesenchymallike_NonResponders_BT_scr"


def test_na_tokens_give_null(spark):
    u = "Mitotic_NA_NA_x_GC1_4"
    assert _one(spark, L.response_of, u) is None
    assert _one(spark, L.timepoint_of, u) is None
    assert _one(spark, L.human_cell_type, u) == "Mitotic"


def test_mouse_name_golden(spark):
    u = "T/NKcell_S1_44"
    assert _one(spark, lambda c: L.sample_of(c, 1, 1), u) == "S1"
    assert _one(spark, L.mouse_cell_type, u) == "T/NKcell"


def test_cluster_rewrites(spark):
    assert _one(spark, L.normalise_cluster, "Stress(p53Response)") == "Stressp53Response"
    assert _one(spark, L.normalise_cluster, "Patient_specific_A") == "PatientspecificA"
    assert _one(spark, L.normalise_cluster, "Mitochondrial(low_quality)") == "Mitochondriallowquality"


def test_violin_rule_first_pattern(spark):
    # violins use "Antigen", the other reports "AntigenPresentation"
    u = "Antigen_NA_BT_s_GC1_3"
    assert _one(spark, lambda c: L.human_cell_type(c, violin=True), u) == "Antigen Presentation"
    assert _one(spark, L.human_cell_type, u) is None


def test_q7_substring_of_whole_name(spark):
    # "4-NOT SPECIFIED" contains OT: the first matching rule over the whole name wins
    assert _one(spark, L.timepoint_of, "4-NOTSPECIFIED_NA_BT_S1_GC1_9") == "BT"
    assert _one(spark, L.timepoint_of, "4-NOTSPECIFIED_NA_NA_S1_GC1_9") == "OT"


def test_composite_key_na_text(spark):
    # NULL renders as NA, spaces removed after joining
    df = spark.createDataFrame([("A b", None, "BT", "s", "GC 1")], "c string, r string, t string, i string, p string")
    stem = df.select(L.remove_spaces(L.composite_key(["c", "r", "t", "i", "p"])).alias("s")).collect()[0]["s"]
    assert stem == "Ab_NA_BT_s_GC1"


def test_log_or_zero_golden(spark):
    rows = [(0.0,), (1.0,), (math.e,), (None,), (-2.0,), (float("inf"),), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    got = [r["y"] for r in df.select(L.log_or_zero("x").alias("y")).collect()]
    assert got[:5] == [0.0, 0.0, 1.0, 0.0, 0.0]
    assert got[5:] == [0.0, 0.0]


def test_q4_not_matching_keeps_null(spark):
    df = spark.createDataFrame([("Patient specific A",), (None,), ("Mitotic",)], "ct string")
    kept = [r["ct"] for r in df.where(L.not_matching("ct", "Patient")).collect()]
    assert sorted(kept, key=lambda v: v or "") == [None, "Mitotic"]


def test_q6_timepoint_selection_ignores_case(spark):
    df = spark.createDataFrame([("Mitotic_NA_NA_s_GC1_2",), ("Melanocytic_NA_NA_s_GC1_2",)], "unit string")
    from setscore.operators.reshape import select_timepoint_units
    kept = [r["unit"] for r in select_timepoint_units(df).collect()]
    assert kept == ["Mitotic_NA_NA_s_GC1_2"]   # "ot" in Mitotic


def test_f4_dot_dash_filter(spark):
    df = spark.createDataFrame([("HLA-B",), ("AC1.2",), ("CD4",)], "gene string")
    assert [r["gene"] for r in df.where(L.has_no_dot_or_dash("gene")).collect()] == ["CD4"]
