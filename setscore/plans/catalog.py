"""Registered queries over the driver tables, and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs a report on the fixture
mapping of FIXTURES.md; ``ORACLE_SQL[name]`` is the same computation written
independently in SQL over the raw tables. Doubles whose last bits depend on
summation order are rounded to a fixed number of digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscore.functions import labels as L
from setscore.operators import pseudobulk as PB
from setscore.operators.reshape import long_to_wide
from setscore.operators.scoring import gene_stats, kernel_cdf, score_sparse, scores_wide
from setscore.plans import reports as R
from setscore.session import cut_lineage, file_state, scratch_folder
from setscore.sources import fixtures as fx
from setscore.sources.expression import read_cell_layout, read_cells, read_expression, read_matrix, write_cell_layout, write_matrix, write_pseudobulk
from setscore.sources.gene_sets import gene_set_table, read_gene_sets, score_sets

MEAN_DIGITS = 9
SCORE_DIGITS = 6
STAT_DIGITS = 9

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------------------------------------
# Shared Spark inputs (scores are computed once per session and state of the input files, X5)

_SCORES: dict[tuple, DataFrame] = {}


def _scores(spark: SparkSession, sf_dir: str, kind: str = "human") -> DataFrame:
    key = (spark.sparkContext.applicationId, kind, file_state(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _SCORES:
        expr = fx.expr_dense(spark, sf_dir) if kind == "human" else fx.expr_mouse(spark, sf_dir)
        _SCORES[key] = R.scores_for(expr, score_sets(fx.demo_gene_sets_wide(spark)))
    return _SCORES[key]


def _sets(spark: SparkSession) -> DataFrame:
    return score_sets(fx.demo_gene_sets_wide(spark))


def _rnd(df: DataFrame, cols: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), cols[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


def _star_marker_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide gene-set table derived from the star fixture: genes seen in BT cells, in OT cells."""
    counts = fx.counts_star(spark, sf_dir)
    cells = fx.cells_star(spark, sf_dir)
    j = counts.join(cells.select("cell_id", "timepoint"), "cell_id")
    return j.groupBy("gene").agg(
        F.max(F.when(F.col("timepoint") == "BT", F.col("gene"))).alias("bt_genes"),
        F.max(F.when(F.col("timepoint") == "OT", F.col("gene"))).alias("ot_genes"),
        F.count(F.lit(1)).alias("n_cells")).drop("gene")


# Fixed value: minimum share of cells a gene must be detected in to be kept.
MIN_DETECTION_RATE = 0.01


def _star_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected genes: non-zero in at least MIN_DETECTION_RATE of all cells."""
    counts = fx.counts_star(spark, sf_dir)
    n_cells = fx.cells_star(spark, sf_dir).agg(F.count(F.lit(1))).scalar()   # scalar subquery
    per_gene = counts.where(F.col("value") != 0).groupBy("gene").agg(F.count(F.lit(1)).alias("k"))
    return per_gene.where(F.col("k") >= F.lit(MIN_DETECTION_RATE) * n_cells).select("gene")


def _malignant_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells_star(spark, sf_dir)
    return cells.withColumn("cluster", L.prefixed(F.substring("cluster", 1, 1), "cluster_"))


# ---------------------------------------------------------------------------------------------
# Spark queries

def q_pseudobulk_star(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), PB.HUMAN_KEYS)
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


def q_pseudobulk_bucketed(spark, sf_dir):
    """S2 -> J1 -> A1 over the stored layout: counts and cells bucketed by cell_id, written and read back."""
    path = scratch_folder(spark, "cell-layout")
    write_cell_layout(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _rnd(PB.pseudobulk(*read_cell_layout(spark, path), PB.HUMAN_KEYS), {"mean_exp": MEAN_DIGITS})


def q_pseudobulk_text(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_text(spark, sf_dir), fx.cells_text(spark, sf_dir), ("cluster", "ident"), hash_cells=True)
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


def q_pseudobulk_malignant(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_star(spark, sf_dir), _malignant_cells(spark, sf_dir),
                       PB.MOUSE_MALIGNANT_KEYS, filter_col="cluster")
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


# Order priorities without blanks, the clusters of the star fixture.
STAR_CLUSTERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOTSPECIFIED", "5-LOW"]


def q_pseudobulk_wide(spark, sf_dir):
    """Pseudobulk by cluster, one column per cluster, 0 where a gene has no count."""
    pb = _rnd(PB.pseudobulk(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), ("cluster",)), {"mean_exp": MEAN_DIGITS})
    return long_to_wide(pb.withColumn("stem", F.regexp_replace("unit", "_[0-9]+$", "")), "gene", "stem", "mean_exp", STAR_CLUSTERS)


def q_pseudobulk_allowlist(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), PB.HUMAN_KEYS,
                       gene_allowlist=_star_allowlist(spark, sf_dir))
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


def q_heatmap_from_pseudobulk(spark, sf_dir):
    """R1 -> R8: counts to the sparse pseudobulk to the log heatmap of genes of interest."""
    keys = ("cluster", "timepoint", "ident")
    counts, cells = fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir)
    units = PB.unit_sizes(PB.keyed_cells(cells, keys)).select("unit", F.split("stem", "_")[0].alias("cell_type"))
    wanted = _star_gene_families(spark, sf_dir, max_size=10)
    heat = R.heatmap_from_pseudobulk(PB.pseudobulk(counts, cells, keys), units, wanted)
    return _rnd(heat, {"log_exp": STAT_DIGITS})


def q_gene_name_clean(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), PB.HUMAN_KEYS,
                       drop_dot_dash_genes=True)
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


def q_gene_sets_long(spark, sf_dir):
    return score_sets(_star_marker_table(spark, sf_dir))


def q_gene_set_table(spark, sf_dir):
    return gene_set_table(_star_marker_table(spark, sf_dir))


def q_unit_labels_human(spark, sf_dir):
    return L.human_unit_labels(fx.units_dense(spark, sf_dir).select("unit"))


def q_unit_labels_mouse(spark, sf_dir):
    return L.mouse_unit_labels(fx.units_mouse(spark, sf_dir).select("unit"))


# Raw cluster spellings (before rewriting), indexed by embeddings.label.
RAW_CLUSTERS = [
    "Antigen_Presentation", "Interferon_Alpha_Beta_Response", "Melanocytic", "Mesenchymal_like",
    "Mitochondrial(low_quality)", "Mitotic", "Neural_Crest_like", "Patient_specific_A",
    "Patient_specific_B", "Stress(HypoxiaResponse)",
]


def q_cluster_normalise(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    raw = fx._lookup(F.col("label"), RAW_CLUSTERS)
    cells = e.select(F.col("vec_id").cast("string").alias("cell_id"), raw.alias("raw_cluster"))
    return cells.select("cell_id", "raw_cluster", L.normalise_cluster("raw_cluster").alias("cluster"))


def _star_gene_families(spark: SparkSession, sf_dir: str, max_size: int | None = None) -> DataFrame:
    """One gene set per part type: every star-fixture gene of that type (of parts up to ``max_size``)."""
    part = fx.table(spark, sf_dir, "part")
    if max_size is not None:
        part = part.where(F.col("p_size") <= max_size)
    sep = F.when(F.col("p_size") % 3 == 0, ".").when(F.col("p_size") % 3 == 1, "-").otherwise("")
    return part.select(F.col("p_type").alias("set_name"),
                       F.concat(F.col("p_brand"), sep, F.col("p_type")).alias("gene")).distinct()


def q_score_pseudobulk_star(spark, sf_dir):
    """R1 -> G0: score gene families on the sparse pseudobulk."""
    # the build/score boundary: the pseudobulk is written once (as the reference saves its matrix
    # between layers) and scored as it is, absent values standing for zero
    pb = cut_lineage(PB.pseudobulk(fx.counts_star(spark, sf_dir), fx.cells_star(spark, sf_dir), PB.HUMAN_KEYS))
    scores = score_sparse(pb.select("unit", "gene", F.col("mean_exp").alias("value")), _star_gene_families(spark, sf_dir))
    return _rnd(scores, {"score": SCORE_DIGITS})


def q_kernel_cdf(spark, sf_dir):
    expr = fx.expr_dense(spark, sf_dir)
    return _rnd(kernel_cdf(expr, gene_stats(expr)), {"z": STAT_DIGITS})


def q_score_long(spark, sf_dir):
    return _rnd(_scores(spark, sf_dir), {"score": SCORE_DIGITS})


def q_score_wide(spark, sf_dir):
    w = scores_wide(_scores(spark, sf_dir), [R.SET_1, R.SET_2])
    return _rnd(w, {R.SET_1: SCORE_DIGITS, R.SET_2: SCORE_DIGITS})


def q_score_ranking(spark, sf_dir):
    return R.ranking_human(_scores(spark, sf_dir))


def q_score_ranking_top10(spark, sf_dir):
    """W3 as a top-k report: the 10 highest-scoring units."""
    return R.ranking_human(_scores(spark, sf_dir), top=10)


def q_score_ranking_mouse(spark, sf_dir):
    return R.ranking_mouse(_scores(spark, sf_dir, "mouse"))


_BOX = {"q1": STAT_DIGITS, "median": STAT_DIGITS, "q3": STAT_DIGITS, "lower": STAT_DIGITS, "upper": STAT_DIGITS}


def q_score_by_celltype_box(spark, sf_dir):
    return _rnd(R.celltype_box(_scores(spark, sf_dir)), _BOX)


def q_score_by_celltype_outliers(spark, sf_dir):
    return _rnd(R.celltype_outliers(_scores(spark, sf_dir)), {"score": SCORE_DIGITS})


def q_score_density(spark, sf_dir):
    d = R.celltype_density(_scores(spark, sf_dir))
    return _rnd(d.withColumn("i", F.col("i").cast("long")),
                {"x": STAT_DIGITS, "density": STAT_DIGITS, "scaled": STAT_DIGITS})


_DENS = {"x": STAT_DIGITS, "density": STAT_DIGITS, "scaled": STAT_DIGITS}


def q_score_density_timepoint(spark, sf_dir):
    d = R.timepoint_density(_scores(spark, sf_dir))
    return _rnd(d.withColumn("i", F.col("i").cast("long")), _DENS)


def q_response_box(spark, sf_dir):
    return _rnd(R.response_box(_scores(spark, sf_dir)), _BOX)


def q_response_density(spark, sf_dir):
    d = R.response_density(_scores(spark, sf_dir))
    return _rnd(d.withColumn("i", F.col("i").cast("long")), _DENS)


def q_score_by_timepoint(spark, sf_dir):
    return _rnd(R.timepoint_box(_scores(spark, sf_dir)), _BOX)


def q_score_by_sample_response(spark, sf_dir):
    return _rnd(R.sample_response_means(_scores(spark, sf_dir)), {"mean_expression": STAT_DIGITS})


def q_response_wilcoxon(spark, sf_dir):
    return _rnd(R.response_wilcoxon(_scores(spark, sf_dir)), {"w": STAT_DIGITS, "p_normal": STAT_DIGITS})


def q_response_wilcoxon_exact(spark, sf_dir):
    """R7 with the p that the reference reports: exact for small groups without ties."""
    return _rnd(R.response_wilcoxon(_scores(spark, sf_dir), p_method="reference"),
                {"w": STAT_DIGITS, "p_normal": STAT_DIGITS, "p": STAT_DIGITS})


def q_response_wilcoxon_single(spark, sf_dir):
    """R7 of one signature."""
    return _rnd(R.response_wilcoxon(_scores(spark, sf_dir), p_method="normal", set_name=R.SET_2),
                {"w": STAT_DIGITS, "p_normal": STAT_DIGITS, "p": STAT_DIGITS})


def q_response_mean_marker(spark, sf_dir):
    return _rnd(R.response_mean_marker(_scores(spark, sf_dir)), {"mean_marker": STAT_DIGITS})


def q_heatmap_celltype(spark, sf_dir):
    return _rnd(R.heatmap_celltype(fx.expr_heat(spark, sf_dir), _sets(spark)), {"log_exp": STAT_DIGITS})


def q_heatmap_celltype_timepoint(spark, sf_dir):
    return _rnd(R.heatmap_celltype_timepoint(fx.expr_heat(spark, sf_dir), _sets(spark)),
                {"log_exp": STAT_DIGITS})


def q_heatmap_mouse(spark, sf_dir):
    return _rnd(R.heatmap_celltype(_mouse_heat(spark, sf_dir), _sets(spark), human=False), {"log_exp": STAT_DIGITS})


def q_heatmap_distance(spark, sf_dir):
    return _rnd(R.heatmap_distance(fx.expr_heat(spark, sf_dir), _sets(spark)), {"distance": 6})


def q_corr_genes(spark, sf_dir):
    return _rnd(R.corr_genes(fx.expr_heat(spark, sf_dir), _sets(spark)), {"corr": 6})


def q_corr_groups(spark, sf_dir):
    return _rnd(R.corr_groups(fx.expr_heat(spark, sf_dir), _sets(spark)), {"corr": 6})


_CORR = {"r": STAT_DIGITS, "p": STAT_DIGITS}


def q_score_corr_samples(spark, sf_dir):
    return _rnd(R.score_corr_samples(_scores(spark, sf_dir)), _CORR)


def q_score_corr_celltype(spark, sf_dir):
    return _rnd(R.score_corr(_scores(spark, sf_dir), ["cell_type"]), _CORR)


def q_score_corr_timepoint(spark, sf_dir):
    return _rnd(R.score_corr(_scores(spark, sf_dir), ["timepoint"]), _CORR)


def q_score_corr_both(spark, sf_dir):
    return _rnd(R.score_corr(_scores(spark, sf_dir), ["timepoint", "cell_type"]), _CORR)


def _mouse_heat(spark, sf_dir):
    return fx.expr_mouse(spark, sf_dir).withColumn("value", F.greatest(F.col("value"), F.lit(0.0)) * 100)


def q_score_by_celltype_box_mouse(spark, sf_dir):
    return _rnd(R.celltype_box(_scores(spark, sf_dir, "mouse"), human=False), _BOX)


def q_corr_genes_mouse(spark, sf_dir):
    return _rnd(R.corr_genes(_mouse_heat(spark, sf_dir), _sets(spark), human=False), {"corr": 6})


def q_score_corr_mouse_samples(spark, sf_dir):
    return _rnd(R.score_corr_samples(_scores(spark, sf_dir, "mouse"), human=False), _CORR)


def q_score_corr_mouse_celltype(spark, sf_dir):
    return _rnd(R.score_corr(_scores(spark, sf_dir, "mouse"), ["cell_type"], human=False), _CORR)


def q_heatmap_group_distance(spark, sf_dir):
    return _rnd(R.heatmap_group_distance(fx.expr_heat(spark, sf_dir), _sets(spark)), {"distance": 6})


def q_score_corr_samples_app(spark, sf_dir):
    """R12 as the interactive view parses it: two leading tokens stripped (Q5)."""
    return _rnd(R.score_corr_samples(_scores(spark, sf_dir), n_lead=2), _CORR)


_FIT = {"slope": STAT_DIGITS, "intercept": STAT_DIGITS, "sigma": STAT_DIGITS}


def _fit_out(f: DataFrame, facets: list[str]) -> DataFrame:
    f = f.select(*facets, "n", "slope", "intercept", "sigma").withColumn("n", F.col("n").cast("long"))
    return _rnd(f, _FIT)


def q_score_fit_samples(spark, sf_dir):
    return _fit_out(R.score_fit_samples(_scores(spark, sf_dir)), [])


def q_score_fit_timepoint(spark, sf_dir):
    return _fit_out(R.score_fit(_scores(spark, sf_dir), ["timepoint"]), ["timepoint"])


def q_score_fit_both(spark, sf_dir):
    return _fit_out(R.score_fit(_scores(spark, sf_dir), ["timepoint", "cell_type"]), ["timepoint", "cell_type"])


def q_score_fit(spark, sf_dir):
    f = R.score_fit(_scores(spark, sf_dir), ["cell_type"]).select("cell_type", "n", "slope", "intercept", "sigma")
    return _rnd(f.withColumn("n", F.col("n").cast("long")),
                {"slope": STAT_DIGITS, "intercept": STAT_DIGITS, "sigma": STAT_DIGITS})


def q_score_fit_band(spark, sf_dir):
    return _rnd(R.score_fit_band(_scores(spark, sf_dir), ["cell_type"]),
                {"x": STAT_DIGITS, "fit": STAT_DIGITS, "lower": STAT_DIGITS, "upper": STAT_DIGITS})


_BAND = {"x": STAT_DIGITS, "fit": STAT_DIGITS, "lower": STAT_DIGITS, "upper": STAT_DIGITS}


def q_score_fit_band_samples(spark, sf_dir):
    return _rnd(R.score_fit_band_samples(_scores(spark, sf_dir)), _BAND)


def q_score_fit_band_timepoint(spark, sf_dir):
    return _rnd(R.score_fit_band(_scores(spark, sf_dir), ["timepoint"]), _BAND)


def q_score_fit_band_both(spark, sf_dir):
    return _rnd(R.score_fit_band(_scores(spark, sf_dir), ["timepoint", "cell_type"]), _BAND)


def q_score_fit_band_mouse_samples(spark, sf_dir):
    return _rnd(R.score_fit_band_samples(_scores(spark, sf_dir, "mouse"), human=False), _BAND)


def q_score_fit_band_mouse_celltype(spark, sf_dir):
    return _rnd(R.score_fit_band(_scores(spark, sf_dir, "mouse"), ["cell_type"], human=False), _BAND)


def q_score_fit_mouse_samples(spark, sf_dir):
    return _fit_out(R.score_fit_samples(_scores(spark, sf_dir, "mouse"), human=False), [])


def q_score_fit_mouse_celltype(spark, sf_dir):
    return _fit_out(R.score_fit(_scores(spark, sf_dir, "mouse"), ["cell_type"], human=False), ["cell_type"])


def q_score_density_mouse(spark, sf_dir):
    d = R.celltype_density(_scores(spark, sf_dir, "mouse"), human=False)
    return _rnd(d.withColumn("i", F.col("i").cast("long")), _DENS)


def q_corr_groups_mouse(spark, sf_dir):
    return _rnd(R.corr_groups(_mouse_heat(spark, sf_dir), _sets(spark), human=False), {"corr": 6})


def q_celltype_heatmap_distance(spark, sf_dir):
    return _rnd(R.celltype_heatmap_distance(fx.expr_heat(spark, sf_dir), _sets(spark)), {"distance": 6})


def q_celltype_heatmap_group_distance(spark, sf_dir):
    return _rnd(R.celltype_heatmap_group_distance(fx.expr_heat(spark, sf_dir), _sets(spark)), {"distance": 6})


def q_celltype_heatmap_group_distance_mouse(spark, sf_dir):
    return _rnd(R.celltype_heatmap_group_distance(_mouse_heat(spark, sf_dir), _sets(spark), human=False), {"distance": 6})


def q_corr_genes_distance(spark, sf_dir):
    return _rnd(R.corr_distance(R.corr_genes(fx.expr_heat(spark, sf_dir), _sets(spark)), "gene"), {"distance": 6})


def q_corr_groups_distance(spark, sf_dir):
    return _rnd(R.corr_distance(R.corr_groups(fx.expr_heat(spark, sf_dir), _sets(spark)), "group"), {"distance": 6})


def q_score_ranking_positions(spark, sf_dir):
    return R.ranking_positions(_scores(spark, sf_dir))


def _mouse_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells_star(spark, sf_dir).select("cell_id", F.col("cluster").alias("cell_type"), F.col("ident").alias("sample"))


def q_pseudobulk_mouse_all(spark, sf_dir):
    pb = PB.pseudobulk(fx.counts_star(spark, sf_dir), _mouse_all_cells(spark, sf_dir), PB.MOUSE_ALL_KEYS)
    return _rnd(pb, {"mean_exp": MEAN_DIGITS})


def q_source_expression(spark, sf_dir):
    """S5 -> S1: the pseudobulk, saved and read back."""
    path = scratch_folder(spark, "expression") + "/long"
    write_pseudobulk(q_pseudobulk_mouse_all(spark, sf_dir), path)
    return read_expression(spark, path)


def q_source_matrix(spark, sf_dir):
    """S5 -> S1: the pseudobulk as a dense matrix in blocks of 64 columns, and back as its non-zero values."""
    path = scratch_folder(spark, "matrix")
    write_matrix(q_pseudobulk_mouse_all(spark, sf_dir).withColumnRenamed("mean_exp", "value"), path, block_units=64)
    return read_matrix(spark, path)


def q_source_cells(spark, sf_dir):
    """Saved counts and cells, read back into the pseudobulk."""
    folder = scratch_folder(spark, "cells")
    fx.counts_star(spark, sf_dir).withColumn("value", F.col("value").cast("double")).write.parquet(f"{folder}/counts")
    fx.cells_star(spark, sf_dir).write.parquet(f"{folder}/cells")
    counts, cells = read_cells(spark, f"{folder}/counts", f"{folder}/cells")
    return _rnd(PB.pseudobulk(counts, cells, PB.MOUSE_MALIGNANT_KEYS, filter_col="cluster"), {"mean_exp": MEAN_DIGITS})


def q_source_gene_sets(spark, sf_dir):
    """S3: a saved two-column table of text, separated by semicolons, read back into sets."""
    path = scratch_folder(spark, "gene-sets") + "/csv"
    _star_marker_table(spark, sf_dir).write.option("sep", ";").option("header", "true").csv(path)
    return score_sets(read_gene_sets(spark, path, sep=";"))


QUERIES: dict[str, Query] = {
    "pseudobulk_star": q_pseudobulk_star,
    "pseudobulk_bucketed": q_pseudobulk_bucketed,
    "pseudobulk_text": q_pseudobulk_text,
    "pseudobulk_malignant": q_pseudobulk_malignant,
    "pseudobulk_wide": q_pseudobulk_wide,
    "heatmap_from_pseudobulk": q_heatmap_from_pseudobulk,
    "pseudobulk_allowlist": q_pseudobulk_allowlist,
    "gene_name_clean": q_gene_name_clean,
    "gene_sets_long": q_gene_sets_long,
    "gene_set_table": q_gene_set_table,
    "unit_labels_human": q_unit_labels_human,
    "unit_labels_mouse": q_unit_labels_mouse,
    "cluster_normalise": q_cluster_normalise,
    "kernel_cdf": q_kernel_cdf,
    "score_pseudobulk_star": q_score_pseudobulk_star,
    "score_long": q_score_long,
    "score_wide": q_score_wide,
    "score_ranking": q_score_ranking,
    "score_ranking_top10": q_score_ranking_top10,
    "score_ranking_mouse": q_score_ranking_mouse,
    "score_by_celltype_box": q_score_by_celltype_box,
    "score_by_celltype_outliers": q_score_by_celltype_outliers,
    "score_density": q_score_density,
    "score_by_timepoint": q_score_by_timepoint,
    "score_density_timepoint": q_score_density_timepoint,
    "response_box": q_response_box,
    "response_density": q_response_density,
    "score_by_sample_response": q_score_by_sample_response,
    "response_wilcoxon": q_response_wilcoxon,
    "response_wilcoxon_exact": q_response_wilcoxon_exact,
    "response_mean_marker": q_response_mean_marker,
    "heatmap_celltype": q_heatmap_celltype,
    "heatmap_celltype_timepoint": q_heatmap_celltype_timepoint,
    "heatmap_mouse": q_heatmap_mouse,
    "heatmap_distance": q_heatmap_distance,
    "corr_genes": q_corr_genes,
    "corr_groups": q_corr_groups,
    "score_corr_samples": q_score_corr_samples,
    "score_corr_celltype": q_score_corr_celltype,
    "score_corr_timepoint": q_score_corr_timepoint,
    "score_corr_both": q_score_corr_both,
    "score_by_celltype_box_mouse": q_score_by_celltype_box_mouse,
    "corr_genes_mouse": q_corr_genes_mouse,
    "score_corr_mouse_samples": q_score_corr_mouse_samples,
    "score_corr_mouse_celltype": q_score_corr_mouse_celltype,
    "heatmap_group_distance": q_heatmap_group_distance,
    "score_corr_samples_app": q_score_corr_samples_app,
    "score_fit_samples": q_score_fit_samples,
    "score_fit_timepoint": q_score_fit_timepoint,
    "score_fit_both": q_score_fit_both,
    "score_fit": q_score_fit,
    "score_fit_band": q_score_fit_band,
    "score_fit_band_samples": q_score_fit_band_samples,
    "score_fit_band_timepoint": q_score_fit_band_timepoint,
    "score_fit_band_both": q_score_fit_band_both,
    "score_fit_band_mouse_samples": q_score_fit_band_mouse_samples,
    "score_fit_band_mouse_celltype": q_score_fit_band_mouse_celltype,
    "score_fit_mouse_samples": q_score_fit_mouse_samples,
    "score_fit_mouse_celltype": q_score_fit_mouse_celltype,
    "score_density_mouse": q_score_density_mouse,
    "response_wilcoxon_single": q_response_wilcoxon_single,
    "corr_groups_mouse": q_corr_groups_mouse,
    "celltype_heatmap_distance": q_celltype_heatmap_distance,
    "celltype_heatmap_group_distance": q_celltype_heatmap_group_distance,
    "celltype_heatmap_group_distance_mouse": q_celltype_heatmap_group_distance_mouse,
    "corr_genes_distance": q_corr_genes_distance,
    "corr_groups_distance": q_corr_groups_distance,
    "score_ranking_positions": q_score_ranking_positions,
    "pseudobulk_mouse_all": q_pseudobulk_mouse_all,
    "source_expression": q_source_expression,
    "source_matrix": q_source_matrix,
    "source_cells": q_source_cells,
    "source_gene_sets": q_source_gene_sets,
}

# ---------------------------------------------------------------------------------------------
# Oracle SQL (DuckDB over the raw tables). Rules, patterns and constants are written out here, not
# taken from the code that they check.

# The label rules, as SQL over a unit name u.
_SQL_ANTIGEN = "WHEN contains({u}, 'AntigenPresentation') THEN 'Antigen Presentation'"
_SQL_ANTIGEN_VIOLIN = "WHEN contains({u}, 'Antigen') THEN 'Antigen Presentation'"
_SQL_HUMAN_CELL_TYPES = """
 WHEN contains({u}, 'Interferon') THEN 'Interferon Alpha Beta Response'
 WHEN contains({u}, 'Melanocytic') THEN 'Melanocytic'
 WHEN contains({u}, 'Mesenchymallike') THEN 'Mesenchymal like'
 WHEN contains({u}, 'Mitochondrial') THEN 'Mitochondrial low quality'
 WHEN contains({u}, 'Mitotic') THEN 'Mitotic'
 WHEN contains({u}, 'NeuralCrestlike') THEN 'Neural Crest like'
 WHEN contains({u}, 'PatientspecificA') THEN 'Patient specific A'
 WHEN contains({u}, 'PatientspecificB') THEN 'Patient specific B'
 WHEN contains({u}, 'Hypoxia') THEN 'Stress Hypoxia Response'
 WHEN contains({u}, 'p53') THEN 'Stress p53 Response'"""
_SQL_MOUSE_CELL_TYPES = """
 WHEN contains({u}, 'B-cell') THEN 'B-cell'
 WHEN contains({u}, 'CAF') THEN 'CAF'
 WHEN contains({u}, 'DC') THEN 'DC'
 WHEN contains({u}, 'EC') THEN 'EC'
 WHEN contains({u}, 'Malignant') THEN 'Malignant'
 WHEN contains({u}, 'Monocyte') THEN 'Monocyte/macrophage'
 WHEN contains({u}, 'Pericyte') THEN 'Pericyte'
 WHEN contains({u}, 'NKcell') THEN 'T/NKcell'"""
_SQL_TIMEPOINT = "(CASE WHEN contains({u}, 'BT') THEN 'BT' WHEN contains({u}, 'OT') THEN 'OT' END)"
_SQL_RESPONSE = ("(CASE WHEN contains({u}, '_NonResponders') THEN 'Non Responders' "
                 "WHEN contains({u}, '_Responders') THEN 'Responders' END)")
# Cluster rewrites, innermost first.
_SQL_REWRITES = """replace(replace(replace(replace(replace(replace(replace(replace({c},
 'Antigen_Presentation', 'AntigenPresentation'),
 'Interferon_Alpha_Beta_Response', 'InterferonAlphaBetaResponse'),
 'Mesenchymal_like', 'Mesenchymallike'),
 'Mitochondrial(low_quality)', 'Mitochondriallowquality'),
 'Neural_Crest_like', 'NeuralCrestlike'),
 'Patient_specific_', 'Patientspecific'),
 'Stress(HypoxiaResponse)', 'StressHypoxiaResponse'),
 'Stress(p53Response)', 'Stressp53Response')"""
# The key columns of the pseudobulk builds.
_SQL_HUMAN_KEYS = ("cluster", "response", "timepoint", "ident", "patient")
_SQL_MOUSE_KEYS = ("cell_type", "sample")
_SQL_MALIGNANT_KEYS = ("ident", "cluster")


def _sql_cell_type(u: str, human: bool = True, violin: bool = False) -> str:
    if not human:
        return "(CASE" + _SQL_MOUSE_CELL_TYPES.replace("{u}", u) + " END)"
    first = _SQL_ANTIGEN_VIOLIN if violin else _SQL_ANTIGEN
    return "(CASE " + (first + _SQL_HUMAN_CELL_TYPES).replace("{u}", u) + " END)"


def _sql_less_last(u: str, times: int) -> str:
    """A name without its last ``times`` tokens: every token but them, joined again."""
    return f"array_to_string(string_split({u}, '_')[:-{times + 1}], '_')"


def _sql_sample(u: str, n_lead: int, n_trail: int) -> str:
    return f"array_to_string(string_split({u}, '_')[{n_lead + 1}:-{n_trail + 1}], '_')"


def _sql_log(x: str) -> str:
    return f"(CASE WHEN {x} > 0 AND isfinite({x}) THEN ln({x}) ELSE 0.0 END)"


def _sql_phi(u: str) -> str:
    """Normal distribution function: Hart's rational form, a continued fraction beyond 7.07."""
    a = f"abs({u})"
    num, den = "0.0352624965998911", "0.0883883476483184"
    for c in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        num = f"({num} * {a} + {c})"
    for c in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831", "793.826512519948", "440.413735824752"):
        den = f"({den} * {a} + {c})"
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    tail = f"(exp({a} * {a} * -0.5) * CASE WHEN {a} < 7.07106781186547 THEN {num} / {den} ELSE 1 / ({far} * sqrt(2 * pi())) END)"
    return f"(CASE WHEN ({u}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c.strip())


def _key_sql(keys) -> str:
    return " || '_' || ".join(f"coalesce(CAST({k} AS VARCHAR), 'NA')" for k in keys)


def _pb_ctes(cells_sql: str, counts_sql: str, keys, filter_col: str, count_filter: str = "",
             digits: int | None = MEAN_DIGITS) -> list[str]:
    mean = "s.s / z.cell_count" if digits is None else f"round(s.s / z.cell_count, {digits})"
    return [
        f"cells AS ({cells_sql})",
        f"counts0 AS ({counts_sql})",
        f"counts AS (SELECT * FROM counts0 {count_filter})",
        f"keyed AS (SELECT cell_id, replace({_key_sql(keys)}, ' ', '') AS stem FROM cells WHERE {filter_col} IS NOT NULL)",
        "sizes AS (SELECT stem, count(*) AS cell_count FROM keyed GROUP BY stem)",
        "sums AS (SELECT k.stem, c.gene, sum(c.value) AS s FROM counts c JOIN keyed k ON c.cell_id = k.cell_id GROUP BY k.stem, c.gene)",
        f"pb AS (SELECT s.gene, z.stem || '_' || CAST(z.cell_count AS VARCHAR) AS unit, "
        f"{mean} AS mean_exp, z.cell_count FROM sums s JOIN sizes z ON s.stem = z.stem)",
    ]


_PB_STAR = _pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, _SQL_HUMAN_KEYS, "cluster")

_MARKER_SQL = """
marker AS (SELECT max(CASE WHEN k.timepoint = 'BT' THEN c.gene END) AS bt_genes,
                  max(CASE WHEN k.timepoint = 'OT' THEN c.gene END) AS ot_genes, count(*) AS n_cells
           FROM counts c JOIN cells k ON c.cell_id = k.cell_id GROUP BY c.gene)"""


def _human_label_cols(u: str = "unit", n_lead: int = 3, n_trail: int = 2, violin: bool = False) -> str:
    return (f"{_sql_sample(u, n_lead, n_trail)} AS sample, {_SQL_RESPONSE.replace('{u}', u)} AS response, "
            f"{_SQL_TIMEPOINT.replace('{u}', u)} AS timepoint, {_sql_cell_type(u, True, violin)} AS cell_type")


def _score_chain() -> list[str]:
    """GSVA over CTEs ``expr(unit, gene, value)`` and ``sets(set_name, gene)``."""
    pen = "(CASE WHEN p = m THEN 0.0 ELSE (pos - k) / (p - m) END)"
    return [
        "gkeep AS (SELECT gene, count(value) AS n, stddev_samp(value) / 4.0 AS h FROM expr GROUP BY gene "
        "HAVING stddev_samp(value) > 0)",
        f"kz AS (SELECT a.unit, a.gene, sum({_sql_phi('(a.value - b.value) / g.h')}) / g.n AS z "
        "FROM expr a JOIN gkeep g ON a.gene = g.gene JOIN expr b ON b.gene = a.gene GROUP BY a.unit, a.gene, g.n)",
        "ranked AS (SELECT unit, gene, z, row_number() OVER (PARTITION BY unit ORDER BY round(z, 9) DESC, gene ASC) AS pos, "
        "count(*) OVER (PARTITION BY unit) AS p FROM kz)",
        "weighted AS (SELECT *, abs(p - pos + 1 - p / 2.0) AS r FROM ranked)",
        "hits AS (SELECT w.unit, s.set_name, w.pos, w.p, w.r FROM weighted w "
        "JOIN (SELECT DISTINCT set_name, gene FROM sets) s ON w.gene = s.gene)",
        "walk AS (SELECT unit, set_name, pos, p, r, "
        "row_number() OVER (PARTITION BY unit, set_name ORDER BY pos) AS k, "
        "count(*) OVER (PARTITION BY unit, set_name) AS m, "
        "sum(r) OVER (PARTITION BY unit, set_name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr, "
        "sum(r) OVER (PARTITION BY unit, set_name) AS tot FROM hits)",
        f"dev AS (SELECT unit, set_name, cr / tot - {pen} AS hi, (cr - r) / tot - {pen} AS lo FROM walk)",
        "scores AS (SELECT unit, set_name, coalesce(greatest(max(hi), 0.0) + least(min(lo), 0.0), 0.0) AS score "
        "FROM dev GROUP BY unit, set_name)",
        "wide AS (SELECT unit, max(CASE WHEN set_name = 'gene_sig_score_1' THEN score END) AS gene_sig_score_1, "
        "max(CASE WHEN set_name = 'gene_sig_score_2' THEN score END) AS gene_sig_score_2 FROM scores GROUP BY unit)",
    ]


def _score_ctes(units_sql: str) -> list[str]:
    return [
        f"units AS ({units_sql})",
        f"expr AS ({fx.sql_expr_from('units')})",
        f"sets AS ({fx.sql_demo_gene_sets_long()})",
    ] + _score_chain()


_HUMAN_SCORES = _score_ctes(fx.SQL_UNITS_DENSE)
_MOUSE_SCORES = _score_ctes(fx.SQL_UNITS_MOUSE)

# long scores with violin labels (lead/trail 2/2), the reference's a1
_A1 = f"a1 AS (SELECT s.*, {_human_label_cols('s.unit', 2, 2, True)} FROM scores s)"
# long scores with violin labels, lead 3 (the per-sample response views)
_A1_3 = f"a13 AS (SELECT s.*, {_human_label_cols('s.unit', 3, 2, True)} FROM scores s)"
# wide scores with labels, lead 3
_D1 = f"d1 AS (SELECT w.*, {_human_label_cols('w.unit', 3, 2, False)} FROM wide w)"
_D1F = "d1f AS (SELECT * FROM d1 WHERE NOT coalesce(contains(cell_type, 'Patient'), false))"


def _nse(keys, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys) or "TRUE"


def _box_parts(src: str, keys) -> tuple[list[str], str]:
    """CTEs and final SELECT of the T6 box statistics over ``src``."""
    ks = ", ".join(keys)
    fence = "v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)"
    r = STAT_DIGITS
    ctes = [
        f"q AS (SELECT {ks}, count(score) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, "
        f"quantile_cont(score, 0.75) AS q3 FROM {src} GROUP BY {ks})",
        f"j AS (SELECT {', '.join('t.' + k for k in keys)}, t.score AS v, q.q1, q.q3 FROM {src} t JOIN q ON {_nse(keys, 't', 'q')})",
        f"w AS (SELECT {ks}, min(CASE WHEN {fence} THEN v END) AS lower, max(CASE WHEN {fence} THEN v END) AS upper, "
        f"count(CASE WHEN NOT ({fence}) THEN v END) AS n_outliers FROM j GROUP BY {ks})",
    ]
    select = (f"SELECT {', '.join('q.' + k for k in keys)}, q.n, round(q.q1, {r}) AS q1, round(q.median, {r}) AS median, "
              f"round(q.q3, {r}) AS q3, round(w.lower, {r}) AS lower, round(w.upper, {r}) AS upper, w.n_outliers "
              f"FROM q JOIN w ON {_nse(keys, 'q', 'w')}")
    return ctes, select


# Order of first appearance of each cell type over units in name order
_CT_ORD = ("ct_ord AS (SELECT cell_type, dense_rank() OVER (ORDER BY cell_type IS NULL, first_unit) AS cell_type_ord "
           "FROM (SELECT cell_type, min(unit) AS first_unit FROM a1 GROUP BY cell_type))")


def _t_p_sql(t: str, df: str) -> str:
    """Two-sided Student-t p from the A&S 26.7.3-4 series, terms via lgamma."""
    c = f"(({df}) / (({df}) + ({t}) * ({t})))"
    s = f"(abs({t}) / sqrt(({df}) + ({t}) * ({t})))"
    theta = f"atan(abs({t}) / sqrt({df}))"
    even_sum = (f"(SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + k * ln({c}))) "
                f"FROM range(0, CAST(({df} - 2) / 2 AS BIGINT) + 1) AS g(k))")
    odd_sum = (f"(SELECT sum(exp(lgamma(k + 1) + 0.5 * ln(pi()) - ln(2) - lgamma(k + 1.5) + k * ln({c}))) "
               f"FROM range(0, CAST(({df} - 3) / 2 AS BIGINT) + 1) AS g(k))")
    a = (f"(CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {s} * {even_sum} "
         f"WHEN {df} = 1 THEN 2 * {theta} / pi() "
         f"ELSE 2 / pi() * ({theta} + {s} * sqrt({c}) * {odd_sum}) END)")
    return f"greatest(0.0, least(1.0, 1 - {a}))"


def _spearman_sql(ctes, src: str, facets, x: str, y: str) -> str:
    fs = ", ".join(facets)
    part = f"PARTITION BY {fs}" if facets else ""
    part_x = f"PARTITION BY {fs + ', ' if facets else ''}{x}"
    part_y = f"PARTITION BY {fs + ', ' if facets else ''}{y}"
    sel = f"{fs}, " if facets else ""
    grp = f"GROUP BY {fs}" if facets else ""
    r = STAT_DIGITS
    return _with(
        *ctes,
        f"d AS (SELECT * FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)",
        f"rk AS (SELECT *, rank() OVER ({part} ORDER BY {x}) + (count(*) OVER ({part_x}) - 1) / 2.0 AS rx, "
        f"rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part_y}) - 1) / 2.0 AS ry FROM d)",
        f"m AS (SELECT {sel}count(*) AS n, regr_sxy(ry, rx) AS sxy, regr_sxx(ry, rx) AS sxx, regr_syy(ry, rx) AS syy "
        f"FROM rk {grp})",
        f"c AS (SELECT {sel}n, CASE WHEN sxx * syy > 0 THEN sxy / sqrt(sxx * syy) END AS r, "
        "least(sxx, syy) < (n * n * n - n) / 12.0 - 0.25 AS ties FROM m)",
        "ss AS (SELECT *, 2 * round((n * n * n - n) * (1 - r) / 12.0) AS s0 FROM c)",
        "tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, least(s0, (n * n * n - n) / 3.0 - s0) AS s, "
        "CASE WHEN r IS NULL THEN NULL WHEN NOT ties AND n <= 9 THEN 'exact' WHEN NOT ties AND n < 1290 THEN 'edgeworth' "
        "WHEN n >= 3 THEN 't' END AS p_method FROM ss)",
        # permutations of n by the sum of squared differences, position after position
        "ways(n, k, used, s, c) AS (SELECT DISTINCT n, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::DOUBLE FROM tt WHERE p_method = 'exact' UNION ALL "
        "SELECT n, k + 1, used | (1 << j), ways.s + (k - j) * (k - j), sum(c) FROM ways, range(0, 9) v(j) "
        "WHERE k < n AND j < n AND (used >> j) & 1 = 0 GROUP BY n, k, used | (1 << j), ways.s + (k - j) * (k - j))",
        "exact AS (SELECT tt.n AS of_n, tt.s AS of_s, sum(ways.c) / factorial(any_value(tt.n)::INTEGER) AS tail FROM (SELECT DISTINCT n, s FROM tt WHERE p_method = 'exact') tt "
        "JOIN ways ON ways.n = tt.n AND ways.k = tt.n AND ways.s <= tt.s GROUP BY 1, 2)",
        "xx AS (SELECT *, 1.0 / n AS b, (6.0 * (s + 1) / n / (n * n - 1.0) - 1) * sqrt(n - 1.0) AS x FROM tt LEFT JOIN exact ON p_method = 'exact' AND of_n = n AND of_s = s)",
        "uu AS (SELECT *, x * b * (0.2274 + b * (0.2531 + 0.1745 * b) + x ** 2 * (-0.0758 + b * (0.1033 + 0.3932 * b) "
        "- x ** 2 * b * (0.0879 + 0.0151 * b - x ** 2 * (0.0072 - 0.0831 * b + x ** 2 * b * (0.0131 - 0.00046 * x ** 2))))) * exp(x * x * -0.5) AS u FROM xx)",
    ).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f" SELECT {sel}n, round(r, {r}) AS r, p_method, round(CAST(CASE p_method WHEN 'exact' THEN least(1.0, 2 * tail) "
        f"WHEN 'edgeworth' THEN least(1.0, 2 * greatest(0.0, {_sql_phi('x')} - u)) "
        f"WHEN 't' THEN CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {_t_p_sql('t', '(n - 2)')} END END AS DOUBLE), {r}) AS p FROM uu")


def _heat_ctes(group_expr: str, units_sql: str = fx.SQL_UNITS_DENSE, human: bool = True) -> list[str]:
    sel = (" AND (contains(lower(e.unit), 'ot') OR contains(lower(e.unit), 'bt'))" if human else "")
    tp = _SQL_TIMEPOINT.replace("{u}", "e.unit") if human else "CAST(NULL AS VARCHAR)"
    return [
        f"units AS ({units_sql})",
        f"expr0 AS ({fx.sql_expr_from('units')})",
        "expr AS (SELECT unit, gene, greatest(value, 0.0) * 100 AS value FROM expr0)",
        f"sets AS ({fx.sql_demo_gene_sets_long()})",
        f"h AS (SELECT e.gene, e.unit, e.value, {tp} AS timepoint, {_sql_cell_type('e.unit', human)} AS cell_type "
        f"FROM expr e WHERE e.gene IN (SELECT gene FROM sets){sel})",
        f"means AS (SELECT gene, {group_expr} AS grp, avg(value) AS mean_exp FROM h GROUP BY gene, {group_expr})",
        "grid AS (SELECT g.gene, c.grp FROM (SELECT DISTINCT gene FROM means) g CROSS JOIN (SELECT DISTINCT grp FROM means) c)",
        f"r2 AS (SELECT grid.gene, grid.grp, {_sql_log('m.mean_exp')} AS log_exp FROM grid "
        "LEFT JOIN means m ON grid.gene = m.gene AND grid.grp IS NOT DISTINCT FROM m.grp)",
    ]


_CELL_SAMPLE = "(coalesce(cell_type, 'NA') || ' ' || coalesce(timepoint, 'NA'))"


def _pearson_sql(obs: str, var: str, a_name: str, b_name: str) -> str:
    return _with(
        f"st AS (SELECT {var} AS v, avg(log_exp) AS mu, stddev_samp(log_exp) AS sd, count(log_exp) AS n FROM r2 GROUP BY {var})",
        f"z AS (SELECT r2.{obs} AS o, r2.{var} AS v, CASE WHEN st.sd <> 0 THEN (r2.log_exp - st.mu) / st.sd END AS z, "
        f"st.n - 1 AS dof FROM r2 JOIN st ON r2.{var} IS NOT DISTINCT FROM st.v)",
        f"corr AS (SELECT a.v AS {a_name}, b.v AS {b_name}, sum(a.z * b.z) / first(a.dof) AS corr FROM z a JOIN z b "
        "ON a.o IS NOT DISTINCT FROM b.o GROUP BY a.v, b.v)",
    ) + f" SELECT {a_name}, {b_name}, round(corr, 6) AS corr FROM corr"


def _distance_sql(src: str, obs: str, var: str, value: str, name: str) -> str:
    return (f" SELECT a.{var} AS {name}_a, b.{var} AS {name}_b, round(sqrt(sum((a.{value} - b.{value}) * (a.{value} - b.{value}))"
            f" * count(*) / nullif(count(a.{value} - b.{value}), 0)), 6) AS distance FROM {src} a JOIN {src} b ON a.{obs} IS NOT DISTINCT FROM b.{obs} "
            f"WHERE coalesce(a.{var}, '') < coalesce(b.{var}, '') GROUP BY a.{var}, b.{var}")


def _exact_wilcoxon_sql() -> str:
    """The rank-sum p by the reference's rule; the null distribution counts subsets of the ranks 1..n1+n2."""
    r = STAT_DIGITS
    base = _wilcoxon_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    at = base.rindex(" SELECT set_name, timepoint, n1, n2,")
    ctes, select = base[:at], base[at:]
    return ctes + f""",
test AS ({select}),
small AS (SELECT DISTINCT n1, n2 FROM test WHERE w IS NOT NULL AND NOT has_ties AND n1 < 50 AND n2 < 50),
sums(n1, n2, i, j, s, c) AS (
    SELECT n1, n2, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM small
    UNION ALL
    SELECT n1, n2, i + 1, j + d, s + d * (i + 1), sum(c) FROM sums, (VALUES (0), (1)) AS pick(d)
    WHERE i < n1 + n2 AND j + d <= n1 GROUP BY n1, n2, i + 1, j + d, s + d * (i + 1)),
dist AS (SELECT n1, n2, s - n1 * (n1 + 1) / 2 AS u, c FROM sums WHERE i = n1 + n2 AND j = n1),
tail AS (SELECT t.set_name, t.timepoint, sum(c) FILTER (u <= t.w) / sum(c) AS low, sum(c) FILTER (u >= t.w) / sum(c) AS high
         FROM test t JOIN dist ON t.n1 = dist.n1 AND t.n2 = dist.n2 WHERE NOT t.has_ties GROUP BY t.set_name, t.timepoint, t.w)
SELECT t.*, CASE WHEN t.w IS NULL THEN NULL WHEN tail.low IS NULL THEN 'normal' ELSE 'exact' END AS p_method,
       CASE WHEN tail.low IS NULL THEN t.p_normal ELSE round(least(1.0, 2 * least(tail.low, tail.high)), {r}) END AS p
FROM test t LEFT JOIN tail ON t.set_name = tail.set_name AND t.timepoint IS NOT DISTINCT FROM tail.timepoint"""


def _t_series_sql(t: str, df: str) -> str:
    """Two-sided Student-t p as a finite series over a list (no correlated subquery)."""
    c = f"({df} / ({df} + ({t}) * ({t})))"
    s = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    theta = f"atan(abs({t}) / sqrt({df}))"
    even = (f"coalesce(list_sum(list_transform(range(0, ({df} - 2) // 2 + 1), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + k * ln({c})))), 0.0)")
    odd = (f"coalesce(list_sum(list_transform(range(0, ({df} - 3) // 2 + 1), "
           f"lambda k: exp(lgamma(k + 1) + 0.5 * ln(pi()) - ln(2) - lgamma(k + 1.5) + k * ln({c})))), 0.0)")
    return (f"(1 - CASE WHEN {df} % 2 = 0 THEN {s} * {even} WHEN {df} = 1 THEN 2 * {theta} / pi() "
            f"ELSE 2 / pi() * ({theta} + {s} * sqrt({c}) * {odd}) END)")


def _band_sql(facets, src: str = "d1f", x: str = "gene_sig_score_1", y: str = "gene_sig_score_2", ctes: tuple = ()) -> str:
    """T4 band: the 97.5% point of Student t by bisection of its angle."""
    r = STAT_DIGITS
    fs = "".join(f"{f}, " for f in facets)
    grp = f"GROUP BY {', '.join(facets)}" if facets else ""
    p = _t_series_sql("sqrt(df) * tan((lo + hi) / 2)", "df")
    return _with(*(ctes or (*_HUMAN_SCORES, _D1, _D1F)),
                 f"m AS (SELECT {fs}regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, "
                 f"regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, regr_sxx({y}, {x}) AS sxx, regr_avgx({y}, {x}) AS xbar, "
                 f"min({x}) FILTER ({y} IS NOT NULL) AS xmin, max({x}) FILTER ({y} IS NOT NULL) AS xmax FROM {src} {grp})",
                 "q(df, step, lo, hi) AS (SELECT DISTINCT n::BIGINT - 2, 0, 0.0::DOUBLE, pi() / 2 FROM m WHERE n > 2 UNION ALL "
                 f"SELECT df, step + 1, CASE WHEN {p} > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {p} > 0.05 THEN hi ELSE (lo + hi) / 2 END "
                 "FROM q WHERE step < 52)",
                 "tq AS (SELECT df, sqrt(df) * tan(lo) AS tq FROM q WHERE step = 52)",
                 "g AS (SELECT m.*, tq.tq, i, xmin + (xmax - xmin) * i / 79.0 AS x, sqrt(greatest(syy - slope * sxy, 0.0) / nullif(n - 2, 0)) AS sigma "
                 "FROM m LEFT JOIN tq ON tq.df = m.n - 2, range(0, 80) AS t(i))",
                 "b AS (SELECT *, intercept + slope * x AS fit, tq * CASE WHEN n > 2 THEN sigma END * sqrt(1.0 / n + (x - xbar) * (x - xbar) / sxx) AS half FROM g)",
                 ).replace("WITH ", "WITH RECURSIVE ", 1) + (
        f" SELECT {fs}CAST(i AS INTEGER) AS i, round(x, {r}) AS x, round(fit, {r}) AS fit, round(fit - half, {r}) AS lower, round(fit + half, {r}) AS upper FROM b")


def _heat_prefix(group_expr: str, **kw) -> str:
    return _with(*_heat_ctes(group_expr, **kw))


_A7 = ("means AS (SELECT set_name, sample, response, timepoint, avg(score) AS mean_expression FROM a13 "
       "GROUP BY set_name, sample, response, timepoint)")


def _wilcoxon_sql() -> str:
    r = STAT_DIGITS
    fk = ["set_name", "timepoint"]
    phi_z = _sql_phi("z")
    return _with(
        *_HUMAN_SCORES, _A1_3, _A7,
        "d AS (SELECT set_name, timepoint, response, mean_expression AS v FROM means "
        "WHERE response IN ('Non Responders', 'Responders') AND mean_expression IS NOT NULL)",
        "rk AS (SELECT *, rank() OVER (PARTITION BY set_name, timepoint ORDER BY v) + "
        "(count(*) OVER (PARTITION BY set_name, timepoint, v) - 1) / 2.0 AS rr FROM d)",
        "ties AS (SELECT set_name, timepoint, sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM "
        "(SELECT set_name, timepoint, v, count(*) AS t FROM d GROUP BY set_name, timepoint, v) GROUP BY set_name, timepoint)",
        "m0 AS (SELECT set_name, timepoint, sum(CASE WHEN response = 'Non Responders' THEN rr END) AS rx, "
        "count(CASE WHEN response = 'Non Responders' THEN 1 END) AS n1, "
        "count(CASE WHEN response <> 'Non Responders' THEN 1 END) AS n2 FROM rk GROUP BY set_name, timepoint)",
        f"m AS (SELECT m0.*, ties.tie FROM m0 JOIN ties ON {_nse(fk, 'm0', 'ties')})",
        "w0 AS (SELECT *, rx - n1 * (n1 + 1) / 2.0 AS w, "
        "sqrt((n1 * n2 / 12.0) * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sigma FROM m)",
        "w1 AS (SELECT *, CASE WHEN sigma > 0 THEN (w - n1 * n2 / 2.0 - sign(w - n1 * n2 / 2.0) * 0.5) / sigma END AS z FROM w0)",
    ) + (f" SELECT set_name, timepoint, n1, n2, round(CASE WHEN n1 > 0 AND n2 > 0 THEN w END, {r}) AS w, "
         f"round(CASE WHEN n1 > 0 AND n2 > 0 THEN least(1.0, 2 * least({phi_z}, 1 - {phi_z})) END, {r}) AS p_normal, "
         "tie > 0 AS has_ties FROM w1")


def _density_sql(ctes: tuple = (), src: str = "a1", keys=("set_name", "cell_type"), value: str = "score",
                 order: bool = True) -> str:
    r = STAT_DIGITS
    keys = list(keys)
    ks = ", ".join(keys)
    lo = "least(sd, (q3 - q1) / 1.34)"
    ctes = ctes or (*_HUMAN_SCORES, _A1)
    body = _with(
        *ctes,
        f"st AS (SELECT {ks}, count({value}) AS n, stddev_samp({value}) AS sd, quantile_cont({value}, 0.25) AS q1, "
        f"quantile_cont({value}, 0.75) AS q3, min({value}) AS lo, max({value}) AS hi FROM {src} GROUP BY {ks} "
        f"HAVING count({value}) >= 2)",
        f"bw AS (SELECT *, 0.9 * (CASE WHEN {lo} > 0 THEN {lo} WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1.0 END) "
        "* pow(CAST(n AS DOUBLE), -0.2) AS bw, (hi - lo) / 511.0 AS step FROM st)",
        "g AS (SELECT bw.*, t.i FROM bw, range(0, 512) AS t(i))",
        f"dens AS (SELECT {', '.join('g.' + k for k in keys)}, g.i, g.lo + g.i * g.step AS x, "
        f"sum(exp(-0.5 * ((g.lo + g.i * g.step - a.{value}) / g.bw) * ((g.lo + g.i * g.step - a.{value}) / g.bw))) "
        f"/ (g.n * g.bw * 2.5066282746310002) AS density FROM g JOIN {src} a ON {_nse(keys, 'g', 'a')} "
        f"GROUP BY {', '.join('g.' + k for k in keys)}, g.i, g.lo, g.step, g.n, g.bw)",
        *((_CT_ORD,) if order else ()),
    )
    part = ", ".join("d." + k for k in keys)
    sel = (f" SELECT {part}, CAST(i AS BIGINT) AS i, round(x, {r}) AS x, round(density, {r}) AS density, "
           f"round(density / max(density) OVER (PARTITION BY {part}), {r}) AS scaled")
    if order:
        return body + sel + ", o.cell_type_ord FROM dens d LEFT JOIN ct_ord o ON d.cell_type IS NOT DISTINCT FROM o.cell_type"
    return body + sel + " FROM dens d"


def _fit_sql(facets, src: str = "d1f", x: str = "gene_sig_score_1", y: str = "gene_sig_score_2",
             ctes: tuple = ()) -> str:
    r = STAT_DIGITS
    fs = ", ".join(facets)
    sel = f"{fs}, " if facets else ""
    grp = f"GROUP BY {fs}" if facets else ""
    ctes = ctes or (*_HUMAN_SCORES, _D1, _D1F)
    return _with(*ctes,
                 f"m AS (SELECT {sel}regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, "
                 f"regr_intercept({y}, {x}) AS intercept, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy "
                 f"FROM {src} {grp})") + (
        f" SELECT {sel}CAST(n AS BIGINT) AS n, round(slope, {r}) AS slope, round(intercept, {r}) AS intercept, "
        f"round(CASE WHEN n > 2 THEN sqrt(greatest(syy - slope * sxy, 0.0) / (n - 2)) END, {r}) AS sigma FROM m")


def _sql_catalog() -> dict[str, str]:
    r = STAT_DIGITS
    sql: dict[str, str] = {}
    sql["pseudobulk_star"] = _with(*_PB_STAR) + " SELECT gene, unit, mean_exp, cell_count FROM pb"
    sql["pseudobulk_bucketed"] = sql["pseudobulk_star"]
    sql["pseudobulk_text"] = _with(*_pb_ctes(fx.SQL_CELLS_TEXT, fx.SQL_COUNTS_TEXT, ("cluster", "ident"), "cluster")) + \
        " SELECT gene, unit, mean_exp, cell_count FROM pb"
    mal_cells = (f"SELECT cell_id, ident, 'cluster_' || coalesce(substr(cluster, 1, 1), 'NA') AS cluster "
                 f"FROM ({fx.SQL_CELLS_STAR})")
    sql["pseudobulk_malignant"] = _with(*_pb_ctes(mal_cells, fx.SQL_COUNTS_STAR, _SQL_MALIGNANT_KEYS, "cluster")) + \
        " SELECT gene, unit, mean_exp, cell_count FROM pb"
    sql["pseudobulk_wide"] = _with(*_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, ("cluster",), "cluster")) + " SELECT gene, " + ", ".join(
        f"coalesce(max(mean_exp) FILTER (regexp_replace(unit, '_[0-9]+$', '') = '{c}'), 0.0) AS \"{c}\"" for c in STAR_CLUSTERS) + " FROM pb GROUP BY gene"
    sql["heatmap_from_pseudobulk"] = _with(*_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, ("cluster", "timepoint", "ident"), "cluster", digits=None)) + f"""
, units AS (SELECT stem || '_' || CAST(cell_count AS VARCHAR) AS unit, split_part(stem, '_', 1) AS cluster FROM sizes),
genes AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '' END || p_type AS gene FROM part WHERE p_size <= 10),
dense AS (SELECT g.gene, u.cluster, coalesce(pb.mean_exp, 0.0) AS v FROM genes g CROSS JOIN units u LEFT JOIN pb ON pb.gene = g.gene AND pb.unit = u.unit
          WHERE g.gene IN (SELECT gene FROM pb))
SELECT gene, cluster AS cell_type, round(CASE WHEN avg(v) > 0 THEN ln(avg(v)) ELSE 0.0 END, {r}) AS log_exp FROM dense GROUP BY gene, cluster"""
    allow = ("WHERE gene IN (SELECT gene FROM counts0 WHERE value <> 0 GROUP BY gene "
             f"HAVING count(*) >= {MIN_DETECTION_RATE!r} * (SELECT count(*) FROM cells))")
    sql["pseudobulk_allowlist"] = _with(*_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, _SQL_HUMAN_KEYS, "cluster", allow)) + \
        " SELECT gene, unit, mean_exp, cell_count FROM pb"
    sql["gene_name_clean"] = _with(*_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, _SQL_HUMAN_KEYS, "cluster",
                                             "WHERE NOT contains(gene, '.') AND NOT contains(gene, '-')")) + \
        " SELECT gene, unit, mean_exp, cell_count FROM pb"
    star_base = [f"cells AS ({fx.SQL_CELLS_STAR})", f"counts AS ({fx.SQL_COUNTS_STAR})", _MARKER_SQL]
    sql["gene_sets_long"] = _with(*star_base) + (
        " SELECT DISTINCT set_name, gene FROM (SELECT 'gene_sig_score_1' AS set_name, bt_genes AS gene FROM marker "
        "UNION ALL SELECT 'gene_sig_score_2', ot_genes FROM marker) WHERE gene IS NOT NULL AND gene <> ''")
    sql["gene_set_table"] = _with(*star_base) + \
        " SELECT bt_genes AS gene_signature_1, ot_genes AS gene_signature_2 FROM marker"
    sql["unit_labels_human"] = f"SELECT unit, {_human_label_cols('unit')} FROM ({fx.SQL_UNITS_DENSE})"
    sql["unit_labels_mouse"] = (f"SELECT unit, {_sql_sample('unit', 1, 1)} AS sample, "
                                f"{_sql_cell_type('unit', False)} AS cell_type FROM ({fx.SQL_UNITS_MOUSE})")
    raw = fx._case_sql("label", RAW_CLUSTERS)
    sql["cluster_normalise"] = (f"SELECT CAST(vec_id AS VARCHAR) AS cell_id, {raw} AS raw_cluster, "
                                f"{_SQL_REWRITES.replace("{c}", raw)} AS cluster FROM embeddings")
    sql["kernel_cdf"] = _with(*_HUMAN_SCORES[:5]) + f" SELECT unit, gene, round(z, {r}) AS z FROM kz"
    sql["score_long"] = _with(*_HUMAN_SCORES) + f" SELECT unit, set_name, round(score, {SCORE_DIGITS}) AS score FROM scores"
    sql["score_wide"] = _with(*_HUMAN_SCORES) + (
        f" SELECT unit, round(gene_sig_score_1, {SCORE_DIGITS}) AS gene_sig_score_1, "
        f"round(gene_sig_score_2, {SCORE_DIGITS}) AS gene_sig_score_2 FROM wide")
    sql["score_ranking"] = _with(*_HUMAN_SCORES) + (
        f" SELECT {_sql_less_last('unit', 2)} AS aggregated_sample_cell_type, {_human_label_cols('unit')}, "
        "round(gene_sig_score_1, 3) AS gene_sig_score_1, round(gene_sig_score_2, 3) AS gene_sig_score_2 FROM wide")
    sql["score_ranking_top10"] = _with(*_HUMAN_SCORES) + (
        f" SELECT {_sql_less_last('unit', 2)} AS aggregated_sample_cell_type, {_human_label_cols('unit')}, "
        "round(gene_sig_score_1, 3) AS gene_sig_score_1, round(gene_sig_score_2, 3) AS gene_sig_score_2 FROM wide "
        "ORDER BY wide.gene_sig_score_1 DESC NULLS LAST, unit ASC LIMIT 10")
    sql["score_ranking_mouse"] = _with(*_MOUSE_SCORES) + (
        " SELECT unit AS cell_name, round(gene_sig_score_1, 3) AS gene_sig_score_1, "
        f"round(gene_sig_score_2, 3) AS gene_sig_score_2, {_sql_sample('unit', 1, 1)} AS sample, "
        f"{_sql_cell_type('unit', False)} AS cell_type FROM wide")
    ctes, select = _box_parts("a1", ["set_name", "cell_type"])
    sql["score_by_celltype_box"] = _with(*_HUMAN_SCORES, _A1, _CT_ORD, *ctes, f"boxed AS ({select})") + \
        " SELECT b.*, o.cell_type_ord FROM boxed b LEFT JOIN ct_ord o ON b.cell_type IS NOT DISTINCT FROM o.cell_type"
    sql["score_by_celltype_outliers"] = _with(*_HUMAN_SCORES, _A1, ctes[0]) + (
        f" SELECT t.set_name, t.cell_type, t.unit, round(t.score, {SCORE_DIGITS}) AS score FROM a1 t JOIN q ON {_nse(['set_name', 'cell_type'], 't', 'q')} "
        "WHERE t.score < q1 - 1.5 * (q3 - q1) OR t.score > q3 + 1.5 * (q3 - q1)")
    sql["score_density"] = _density_sql()
    ctes, select = _box_parts("a1", ["set_name", "timepoint"])
    sql["score_by_timepoint"] = _with(*_HUMAN_SCORES, _A1, *ctes) + " " + select
    sql["score_by_sample_response"] = _with(*_HUMAN_SCORES, _A1_3, _A7) + (
        f" SELECT set_name, sample, response, timepoint, round(mean_expression, {r}) AS mean_expression FROM means")
    sql["response_wilcoxon"] = _wilcoxon_sql()
    sql["response_mean_marker"] = _with(*_HUMAN_SCORES, _A1_3, _A7) + (
        f" SELECT set_name, timepoint, response, round(avg(mean_expression), {r}) AS mean_marker FROM means "
        "GROUP BY set_name, timepoint, response")
    sql["heatmap_celltype"] = _heat_prefix("cell_type") + f" SELECT gene, grp AS cell_type, round(log_exp, {r}) AS log_exp FROM r2"
    sql["heatmap_celltype_timepoint"] = _heat_prefix(_CELL_SAMPLE) + \
        f" SELECT gene, grp AS cell_sample, round(log_exp, {r}) AS log_exp FROM r2"
    sql["heatmap_mouse"] = _heat_prefix("cell_type", units_sql=fx.SQL_UNITS_MOUSE, human=False) + \
        f" SELECT gene, grp AS cell_type, round(log_exp, {r}) AS log_exp FROM r2"
    sql["heatmap_distance"] = _heat_prefix(_CELL_SAMPLE) + _distance_sql("r2", "grp", "gene", "log_exp", "gene")
    sql["corr_genes"] = _heat_prefix(_CELL_SAMPLE) + " " + _pearson_sql("grp", "gene", "gene_a", "gene_b").replace("WITH ", ", ", 1)
    sql["corr_groups"] = _heat_prefix(_CELL_SAMPLE) + " " + _pearson_sql("gene", "grp", "group_a", "group_b").replace("WITH ", ", ", 1)
    samples = ("sm AS (SELECT sample, avg(gene_sig_score_1) AS mean_gene1, avg(gene_sig_score_2) AS mean_gene2 "
               "FROM d1 GROUP BY sample)")
    sql["score_corr_samples"] = _spearman_sql([*_HUMAN_SCORES, _D1, samples], "sm", [], "mean_gene1", "mean_gene2")
    for name, facets in (("score_corr_celltype", ["cell_type"]), ("score_corr_timepoint", ["timepoint"]),
                         ("score_corr_both", ["timepoint", "cell_type"])):
        sql[name] = _spearman_sql([*_HUMAN_SCORES, _D1, _D1F], "d1f", facets, "gene_sig_score_1", "gene_sig_score_2")
    sql["score_fit"] = _fit_sql(["cell_type"])
    sql["score_density_timepoint"] = _density_sql(keys=("set_name", "timepoint"), order=False)
    a7 = (*_HUMAN_SCORES, _A1_3, _A7)
    sql["response_density"] = _density_sql(a7, "means", ("set_name", "timepoint", "response"), "mean_expression",
                                           order=False)
    ctes, select = _box_parts("means2", ["set_name", "timepoint", "response"])
    sql["response_box"] = _with(*a7, "means2 AS (SELECT set_name, timepoint, response, mean_expression AS score "
                                     "FROM means)", *ctes) + " " + select
    sql["score_fit_timepoint"] = _fit_sql(["timepoint"])
    sql["score_fit_both"] = _fit_sql(["timepoint", "cell_type"])
    sql["score_fit_samples"] = _fit_sql([], "sm", "mean_gene1", "mean_gene2", (*_HUMAN_SCORES, _D1, samples))
    d1_app = f"d1 AS (SELECT w.*, {_human_label_cols('w.unit', 2, 2, False)} FROM wide w)"
    sql["score_corr_samples_app"] = _spearman_sql([*_HUMAN_SCORES, d1_app, samples], "sm", [], "mean_gene1", "mean_gene2")
    sql["heatmap_group_distance"] = _heat_prefix(_CELL_SAMPLE) + _distance_sql("r2", "gene", "grp", "log_exp", "group")
    sql["celltype_heatmap_distance"] = _heat_prefix("cell_type") + _distance_sql("r2", "grp", "gene", "log_exp", "gene")
    sql["celltype_heatmap_group_distance"] = _heat_prefix("cell_type") + _distance_sql("r2", "gene", "grp", "log_exp", "group")
    sql["celltype_heatmap_group_distance_mouse"] = (_heat_prefix("cell_type", units_sql=fx.SQL_UNITS_MOUSE, human=False)
                                                    + _distance_sql("r2", "gene", "grp", "log_exp", "group"))
    for key, obs, var in (("gene", "grp", "gene"), ("group", "gene", "grp")):
        matrix = _heat_prefix(_CELL_SAMPLE) + " " + _pearson_sql(obs, var, f"{key}_a", f"{key}_b").replace("WITH ", ", ", 1)
        matrix = matrix[:matrix.rindex(" SELECT ")]
        sql[f"corr_{key}s_distance"] = matrix + _distance_sql("corr", f"{key}_b", f"{key}_a", "corr", key)
    sql["response_wilcoxon_exact"] = _exact_wilcoxon_sql()
    sql["response_wilcoxon_single"] = (f"SELECT *, p_normal AS p, CASE WHEN w IS NOT NULL THEN 'normal' END AS p_method "
                                       f"FROM ({_wilcoxon_sql()}) WHERE set_name = 'gene_sig_score_2'")
    sql["score_ranking_positions"] = _with(*_HUMAN_SCORES) + (
        " SELECT unit, row_number() OVER (ORDER BY gene_sig_score_1 DESC NULLS LAST, unit) AS rank FROM wide")
    all_cells = f"SELECT cell_id, cluster AS cell_type, ident AS sample FROM ({fx.SQL_CELLS_STAR})"
    mouse_all = _with(*_pb_ctes(all_cells, fx.SQL_COUNTS_STAR, _SQL_MOUSE_KEYS, "cell_type"))
    sql["pseudobulk_mouse_all"] = mouse_all + " SELECT gene, unit, mean_exp, cell_count FROM pb"
    sql["source_expression"] = mouse_all + " SELECT unit, gene, mean_exp AS value FROM pb"
    sql["source_matrix"] = sql["source_expression"]
    sql["source_cells"] = _with(*_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, _SQL_MALIGNANT_KEYS, "cluster")) + \
        " SELECT gene, unit, mean_exp, cell_count FROM pb"
    sql["source_gene_sets"] = sql["gene_sets_long"]
    sql["score_fit_band"] = _band_sql(["cell_type"])
    sql["score_fit_band_timepoint"] = _band_sql(["timepoint"])
    sql["score_fit_band_both"] = _band_sql(["timepoint", "cell_type"])
    sql["score_fit_band_samples"] = _band_sql([], "sm", "mean_gene1", "mean_gene2", (*_HUMAN_SCORES, _D1, samples))
    mouse_cols = (f"{_sql_sample('{u}', 1, 1)} AS sample, "
                  f"{_sql_cell_type('{u}', False)} AS cell_type")
    a1m = "a1 AS (SELECT s.*, " + mouse_cols.replace("{u}", "s.unit") + " FROM scores s)"
    ctes, select = _box_parts("a1", ["set_name", "cell_type"])
    sql["score_by_celltype_box_mouse"] = _with(*_MOUSE_SCORES, a1m, _CT_ORD, *ctes, f"boxed AS ({select})") + \
        " SELECT b.*, o.cell_type_ord FROM boxed b LEFT JOIN ct_ord o ON b.cell_type IS NOT DISTINCT FROM o.cell_type"
    sql["corr_genes_mouse"] = _heat_prefix("cell_type", units_sql=fx.SQL_UNITS_MOUSE, human=False) + " " + \
        _pearson_sql("grp", "gene", "gene_a", "gene_b").replace("WITH ", ", ", 1)
    d1m = "d1 AS (SELECT w.*, " + mouse_cols.replace("{u}", "w.unit") + " FROM wide w)"
    sql["score_corr_mouse_samples"] = _spearman_sql([*_MOUSE_SCORES, d1m, samples], "sm", [], "mean_gene1", "mean_gene2")
    sql["score_corr_mouse_celltype"] = _spearman_sql([*_MOUSE_SCORES, d1m, _D1F], "d1f", ["cell_type"], "gene_sig_score_1", "gene_sig_score_2")
    sql["score_fit_mouse_samples"] = _fit_sql([], "sm", "mean_gene1", "mean_gene2", (*_MOUSE_SCORES, d1m, samples))
    sql["score_fit_mouse_celltype"] = _fit_sql(["cell_type"], ctes=(*_MOUSE_SCORES, d1m, _D1F))
    sql["score_fit_band_mouse_samples"] = _band_sql([], "sm", "mean_gene1", "mean_gene2", (*_MOUSE_SCORES, d1m, samples))
    sql["score_fit_band_mouse_celltype"] = _band_sql(["cell_type"], ctes=(*_MOUSE_SCORES, d1m, _D1F))
    sql["score_density_mouse"] = _density_sql((*_MOUSE_SCORES, a1m))
    sql["corr_groups_mouse"] = _heat_prefix("cell_type", units_sql=fx.SQL_UNITS_MOUSE, human=False) + " " + \
        _pearson_sql("gene", "grp", "group_a", "group_b").replace("WITH ", ", ", 1)
    gene_sql = "p_brand || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '' END || p_type"
    sql["score_pseudobulk_star"] = _with(
        *_pb_ctes(fx.SQL_CELLS_STAR, fx.SQL_COUNTS_STAR, _SQL_HUMAN_KEYS, "cluster", digits=None),
        "expr AS (SELECT u.unit, g.gene, coalesce(pb.mean_exp, 0.0) AS value FROM (SELECT DISTINCT gene FROM pb) g "
        "CROSS JOIN (SELECT DISTINCT unit FROM pb) u LEFT JOIN pb ON pb.gene = g.gene AND pb.unit = u.unit)",
        f"sets AS (SELECT DISTINCT p_type AS set_name, {gene_sql} AS gene FROM part)",
        *_score_chain()) + f" SELECT unit, set_name, round(score, {SCORE_DIGITS}) AS score FROM scores"
    return sql


ORACLE_SQL: dict[str, str] = _sql_catalog()
