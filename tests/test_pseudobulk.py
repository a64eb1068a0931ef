"""Pseudobulk (A1, A2, F1, F2, P9): golden cases and sparse = dense."""

import numpy as np

from setscore.operators.pseudobulk import HUMAN_KEYS, pseudobulk

CELLS = "cell_id string, cluster string, response string, timepoint string, ident string, patient string"


def test_mean_counts_all_cells(spark):
    # A1 golden: a group of 4 cells, gene with non-zeros 2 and 6 -> mean 2.0, count 4
    cells = spark.createDataFrame([(f"c{i}", "Mitotic", "Responders", "BT", "s1", "GC1") for i in range(4)], CELLS)
    counts = spark.createDataFrame([("G", "c0", 2.0), ("G", "c2", 6.0)], "gene string, cell_id string, value double")
    row = pseudobulk(counts, cells).collect()[0]
    assert row["mean_exp"] == 2.0 and row["cell_count"] == 4
    assert row["unit"] == "Mitotic_Responders_BT_s1_GC1_4"


def test_null_cluster_dropped_null_fields_na(spark):
    cells = spark.createDataFrame([("a", "A b", None, "BT", "s", "GC 1"), ("b", None, "R", "OT", "s", "GC 1")], CELLS)
    counts = spark.createDataFrame([("G", "a", 1.0), ("G", "b", 5.0), ("G", "zz", 9.0)],
                                   "gene string, cell_id string, value double")
    rows = pseudobulk(counts, cells).collect()
    assert [(r["unit"], r["mean_exp"]) for r in rows] == [("Ab_NA_BT_s_GC1_1", 1.0)]


def test_allowlist_and_clean(spark):
    cells = spark.createDataFrame([("a", "X", "R", "BT", "s", "p")], CELLS)
    counts = spark.createDataFrame([("HLA-B", "a", 1.0), ("AC1.2", "a", 1.0), ("CD4", "a", 1.0)],
                                   "gene string, cell_id string, value double")
    allow = spark.createDataFrame([("HLA-B",), ("CD4",)], "gene string")
    assert sorted(r["gene"] for r in pseudobulk(counts, cells, gene_allowlist=allow).collect()) == ["CD4", "HLA-B"]
    assert [r["gene"] for r in pseudobulk(counts, cells, drop_dot_dash_genes=True).collect()] == ["CD4"]


def test_sparse_equals_dense(spark):
    rng = np.random.default_rng(7)
    n_cells, genes = 60, ["g1", "g2", "g3"]
    clusters = rng.choice(["A", "B", "C"], n_cells)
    dense = rng.poisson(0.7, (len(genes), n_cells)).astype(float)
    cells = spark.createDataFrame([(f"c{i}", str(clusters[i]), "R", "BT", "s", "p") for i in range(n_cells)], CELLS)
    trip = [(g, f"c{j}", float(dense[i, j])) for i, g in enumerate(genes) for j in range(n_cells) if dense[i, j] != 0]
    counts = spark.createDataFrame(trip, "gene string, cell_id string, value double")
    got = {(r["gene"], r["unit"].split("_")[0]): r["mean_exp"] for r in pseudobulk(counts, cells, HUMAN_KEYS).collect()}
    for i, g in enumerate(genes):
        for c in "ABC":
            mask = clusters == c
            expect = dense[i, mask].mean()
            if expect:
                assert abs(got[(g, c)] - expect) < 1e-12
