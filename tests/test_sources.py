"""Gene-set file reading (S3, S4, P13) with the encodings the shipped files use."""

import os
import tempfile

from setscore.sources.gene_sets import gene_set_table, read_gene_sets, score_sets

# Bytes laid out like the shipped two-column gene-set file
# (UTF-8 BOM, CRLF line ends, a blank cell, no final newline).
RAGGED = ("\ufeffgene1,gene2\r\nTCF4,CD4\r\nMLANA,CD8A\r\nHLA-B,CD3D\r\nNGFR,CD3E\r\n"
          "CALU,CD2\r\nCOL5A1,\r\nVEGFA,")


def _write(text, suffix=".csv"):
    d = tempfile.mkdtemp(prefix="setscore-test-")
    path = os.path.join(d, "genes" + suffix)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


def test_ragged_bom_crlf(spark):
    raw = read_gene_sets(spark, _write(RAGGED))
    table = gene_set_table(raw).collect()
    assert len(table) == 7
    assert table[0]["gene_signature_1"] == "TCF4"          # BOM stripped from the header, not the data
    assert table[5]["gene_signature_2"] is None            # blank cell -> NULL
    sets = {(r["set_name"], r["gene"]) for r in score_sets(raw).collect()}
    assert len([g for s, g in sets if s == "gene_sig_score_1"]) == 7
    assert len([g for s, g in sets if s == "gene_sig_score_2"]) == 5
    assert ("gene_sig_score_1", "HLA-B") in sets


def test_separators_quotes_header(spark):
    tsv = "'a'\t'b'\textra\n'G1'\t'G2'\tx\n'G3'\t\ty\n"
    raw = read_gene_sets(spark, _write(tsv, ".tsv"), sep="\t", quote="'", header=True)
    sets = sorted((r["set_name"], r["gene"]) for r in score_sets(raw).collect())
    assert sets == [("gene_sig_score_1", "G1"), ("gene_sig_score_1", "G3"), ("gene_sig_score_2", "G2")]
    semi = "G1;G2\nG3;G4\n"
    raw = read_gene_sets(spark, _write(semi), sep=";", quote="", header=False)
    assert score_sets(raw).count() == 4


def test_pseudobulk_write_read_round_trip(spark):
    from setscore.sources.expression import read_expression, write_pseudobulk
    pb = spark.createDataFrame([("G1", "u_1", 1.5, 1), ("G2", "u_1", 0.5, 1), ("G1", "v_2", 2.0, 2)],
                               "gene string, unit string, mean_exp double, cell_count long")
    d = tempfile.mkdtemp(prefix="setscore-test-")
    write_pseudobulk(pb, os.path.join(d, "wide"), units=["u_1", "v_2"])
    back = {(r["unit"], r["gene"]): r["value"] for r in read_expression(spark, os.path.join(d, "wide"), wide=True).collect()}
    assert back == {("u_1", "G1"): 1.5, ("u_1", "G2"): 0.5, ("v_2", "G1"): 2.0, ("v_2", "G2"): 0.0}
    write_pseudobulk(pb, os.path.join(d, "long"))
    back = {(r["unit"], r["gene"]): r["value"] for r in read_expression(spark, os.path.join(d, "long")).collect()}
    assert back == {("u_1", "G1"): 1.5, ("u_1", "G2"): 0.5, ("v_2", "G1"): 2.0}


def test_bucketed_layout_joins_without_exchange(spark):
    """Both sides of the cell join come from their buckets; the result is that of the plain tables."""
    from setscore.operators.pseudobulk import pseudobulk
    from setscore.session import scratch_folder
    from setscore.sources import expression as X
    counts = spark.createDataFrame([(f"g{(3 * i + k) % 11}", f"c{i}", float(k + 1)) for i in range(300) for k in range(4)], X.COUNTS_SCHEMA)
    cells = spark.createDataFrame([(f"c{i}", f"k{i % 7}", "s") for i in range(320)] + [("c999", None, "s")], "cell_id string, cluster string, ident string")
    path = scratch_folder(spark, "test-layout")
    X.write_cell_layout(counts, cells, path, 6)
    X.write_cell_layout(counts, cells, path, 4)              # written anew with other buckets
    assert len([f for f in spark.read.format("binaryFile").load(f"{path}/counts").select("path").collect()]) <= 4
    for fresh in (False, True):
        if fresh:                                            # as a session that hasn't written it
            for kind in ("counts", "cells"):
                spark.sql(f"DROP TABLE {X._layout_name(path)}_{kind}")
        stored = X.read_cell_layout(spark, path)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            keyed = stored[0].join(stored[1].where("cluster IS NOT NULL").select("cell_id", "cluster"), "cell_id")
            plan = keyed._jdf.queryExecution().executedPlan().toString()
            whole = pseudobulk(*stored, ("cluster", "ident"))._jdf.queryExecution().executedPlan().toString()
            plain = pseudobulk(counts, cells, ("cluster", "ident"))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
        assert "hashpartitioning(cell_id" not in whole and "hashpartitioning(cell_id" in plain
        got = pseudobulk(*stored, ("cluster", "ident")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, pseudobulk(counts, cells, ("cluster", "ident")).collect()))


def test_matrix_in_blocks(spark):
    """50,000 units; a block read back as a wide table."""
    from pyspark.sql import functions as F

    from setscore.session import scratch_folder
    from setscore.sources import expression as X
    df = spark.range(50_000).select(F.concat(F.lit("u"), F.format_string("%05d", "id")).alias("unit"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("gene"),
                                    (F.col("id") + 1).cast("double").alias("value"))
    path = scratch_folder(spark, "test-matrix")
    X.write_matrix(df, path, block_units=4096)
    back = X.read_matrix(spark, path)
    assert back.exceptAll(df).count() == 0 and back.count() == 50_000
    assert X.read_matrix(spark, path, zeros=True).count() == 150_000
    block = X.read_matrix_block(spark, path, 12)
    assert block.columns == ["gene", *[f"u{i:05d}" for i in range(12 * 4096, 50_000)]]
    assert {r.gene: r.u49152 for r in block.select("gene", "u49152").collect()} == {"g0": 49153.0, "g1": 0.0, "g2": 0.0}
    odd = spark.createDataFrame([("u.1", "g", None), ("u 2", "g", 2.0)], "unit string, gene string, value double")
    X.write_matrix(odd, path + "-odd")
    assert [tuple(r) for r in X.read_matrix(spark, path + "-odd").collect()] == [("u 2", "g", 2.0)]
