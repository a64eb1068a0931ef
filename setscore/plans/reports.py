"""End-to-end reports (R1-R15) as DataFrame plans.

Every report takes domain frames (``expr``, ``scores``, ``gene_sets``,
``counts``/``cells``) and returns a DataFrame; nothing is collected. Scoring
is the expensive step, so reports take a ``scores`` frame computed once by
:func:`scores_for` (X5) instead of rescoring per report as the reference does.
Labels are column expressions evaluated after the filters, on unit-level rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscore.functions import labels as L
from setscore.operators import association as A
from setscore.operators import ranks
from setscore.operators import summaries as S
from setscore.operators.joins import join_on_keys
from setscore.operators.reshape import select_timepoint_units
from setscore.operators.scoring import score_gene_sets, scores_wide
from setscore.session import cut_lineage
from setscore.sources.gene_sets import SCORE_SET_NAMES

SET_1, SET_2 = SCORE_SET_NAMES


# ---- scores ---------------------------------------------------------------------------------

def scores_for(expr: DataFrame, gene_sets: DataFrame, persist: bool = True) -> DataFrame:
    """G0 once; with ``persist`` the result is checkpointed to the shared checkpoint folder."""
    scores = score_gene_sets(expr, gene_sets)
    return cut_lineage(scores) if persist else scores


def _label_cols(human: bool, n_lead: int, n_trail: int, violin: bool) -> list:
    u = F.col("unit")
    if human:
        return [L.sample_of(u, n_lead, n_trail).alias("sample"), L.response_of(u).alias("response"),
                L.timepoint_of(u).alias("timepoint"), L.human_cell_type(u, violin).alias("cell_type")]
    return [L.sample_of(u, 1, 1).alias("sample"), L.mouse_cell_type(u).alias("cell_type")]


def labelled_scores(scores: DataFrame, human: bool = True, n_lead: int = 3, n_trail: int = 2,
                    violin: bool = False) -> DataFrame:
    """G6 + L3, L5-L8: long scores with sample / response / timepoint / cell type.

    Labels are column expressions on the unit-level score table (one row per
    unit and set), evaluated in the same codegen stage; no join is needed.
    """
    return scores.select("*", *_label_cols(human, n_lead, n_trail, violin))


def labelled_wide(scores: DataFrame, human: bool = True, n_lead: int = 3, n_trail: int = 2) -> DataFrame:
    """G7 + labels: one row per unit with gene_sig_score_1/2 (the reference's d1)."""
    wide = scores_wide(scores, [SET_1, SET_2])
    return wide.select("*", *_label_cols(human, n_lead, n_trail, False))


# ---- R1 / R2 --------------------------------------------------------------------------------
# R1 is operators.pseudobulk.pseudobulk; R2 is sources.gene_sets.gene_set_table.


# ---- R3 ranking -----------------------------------------------------------------------------

def ranking_human(scores: DataFrame, digits: int = 3, top: int | None = None) -> DataFrame:
    """R3 (human): sorted by unrounded score 1 desc (ties by unit), then rounded.

    ``top`` keeps the first k rows (a top-k report: per-partition top-k then a
    merge, no full sort).
    """
    d = labelled_wide(scores, True, 3, 2)
    ordered = d.orderBy(F.col(SET_1).desc_nulls_last(), F.col("unit").asc())
    if top is not None:
        ordered = ordered.limit(top)
    return ordered.select(L.sample_cell_type("unit").alias("aggregated_sample_cell_type"),
                          "sample", "cell_type", "timepoint", "response",
                          F.round(SET_1, digits).alias(SET_1), F.round(SET_2, digits).alias(SET_2))


def ranking_mouse(scores: DataFrame, digits: int = 3) -> DataFrame:
    """R3 (mouse): cell_name, both scores, sample, cell type."""
    d = labelled_wide(scores, False)
    ordered = d.orderBy(F.col(SET_1).desc_nulls_last(), F.col("unit").asc())
    return ordered.select(F.col("unit").alias("cell_name"),
                          F.round(SET_1, digits).alias(SET_1), F.round(SET_2, digits).alias(SET_2),
                          "sample", "cell_type")


def ranking_positions(scores: DataFrame) -> DataFrame:
    """R3's order (W3) as numbers: (unit, rank), rank 1 = largest unrounded score 1, ties by unit."""
    d = labelled_wide(scores).select("unit", F.struct(F.col(SET_1).isNull().alias("none"), (-F.col(SET_1)).alias("down"), "unit").alias("place"))
    at = ranks.value_positions(d, [], "place")
    return at.select(F.col("place.unit").alias("unit"), (F.col("before") + 1).alias("rank"))


# ---- R4 / R5 / R6 / R7 distributions --------------------------------------------------------

def _with_celltype_order(stats: DataFrame, a1: DataFrame) -> DataFrame:
    """X-axis order of cell types = first appearance over units in name order."""
    order = L.first_appearance_order(a1.select("cell_type", "unit"), "cell_type", "unit")
    order = order.select("cell_type", "cell_type_ord").distinct()
    return join_on_keys(stats, order, ["cell_type"], "left")


def celltype_box(scores: DataFrame, human: bool = True) -> DataFrame:
    """R4 (T6 + P12): box statistics of scores per set and cell type (violin label rules)."""
    a1 = labelled_scores(scores, human, 2, 2, violin=True)
    return _with_celltype_order(S.box_stats(a1, ["set_name", "cell_type"], "score"), a1)


def celltype_outliers(scores: DataFrame, human: bool = True) -> DataFrame:
    """R4 (T6): the units drawn as single points beside the boxes: set_name, cell_type, unit, score."""
    a1 = labelled_scores(scores, human, 2, 2, violin=True).select("set_name", "cell_type", "unit", "score")
    return S.box_outliers(a1, ["set_name", "cell_type"], "score")


def celltype_density(scores: DataFrame, human: bool = True, n_points: int = 512) -> DataFrame:
    """R4 (T7 + P12): violin densities per set and cell type."""
    a1 = labelled_scores(scores, human, 2, 2, violin=True)
    return _with_celltype_order(S.violin_density(a1, ["set_name", "cell_type"], "score", n_points), a1)


def timepoint_box(scores: DataFrame) -> DataFrame:
    """R5 (T6): box statistics per set and timepoint, not averaged."""
    a1 = labelled_scores(scores, True, 2, 2, violin=True)
    return S.box_stats(a1, ["set_name", "timepoint"], "score")


def timepoint_density(scores: DataFrame, n_points: int = 512) -> DataFrame:
    """R5 (T7): violin densities per set and timepoint."""
    a1 = labelled_scores(scores, True, 2, 2, violin=True)
    return S.violin_density(a1, ["set_name", "timepoint"], "score", n_points)


def response_box(scores: DataFrame) -> DataFrame:
    """R6 (T6): box statistics of the per-sample means per set, timepoint and response."""
    means = sample_response_means(scores)
    return S.box_stats(means, ["set_name", "timepoint", "response"], "mean_expression")


def response_density(scores: DataFrame, n_points: int = 512) -> DataFrame:
    """R6 / R7 (T7): violin densities of the per-sample means per set, timepoint and response."""
    means = sample_response_means(scores)
    return S.violin_density(means, ["set_name", "timepoint", "response"], "mean_expression", n_points)


def sample_response_means(scores: DataFrame, n_lead: int = 3) -> DataFrame:
    """Mean score per (set, sample, response, timepoint)."""
    a1 = labelled_scores(scores, True, n_lead, 2, violin=True)
    return S.group_mean(a1, ["set_name", "sample", "response", "timepoint"], "score", "mean_expression")


def response_wilcoxon(scores: DataFrame, p_method: str | None = None, set_name: str | None = None) -> DataFrame:
    """Non Responders vs Responders per set and timepoint.

    ``p_method`` (see :func:`A.wilcoxon_p`) adds the columns p and p_method; ``set_name`` keeps one
    signature (F5).
    """
    means = sample_response_means(scores if set_name is None else scores.where(F.col("set_name") == set_name))
    stats = A.wilcoxon(means, ["set_name", "timepoint"], "response", "mean_expression",
                       ("Non Responders", "Responders"))
    return stats if p_method is None else A.wilcoxon_p(stats, ["set_name", "timepoint"], p_method)


def response_mean_marker(scores: DataFrame) -> DataFrame:
    """Mean of the per-sample means per (set, timepoint, response)."""
    return S.group_mean(sample_response_means(scores), ["set_name", "timepoint", "response"],
                        "mean_expression", "mean_marker")


# ---- R8 - R11 heatmaps and matrices -----------------------------------------------------------

def _heat_long(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """F3 -> P8 -> labels: (gene, unit, value, cell_type, timepoint)."""
    e = S.keep_genes(expr, gene_sets)
    if human:
        e = select_timepoint_units(e)
    u = F.col("unit")
    if human:
        return e.select("*", L.timepoint_of(u).alias("timepoint"), L.human_cell_type(u).alias("cell_type"))
    return e.select("*", F.lit(None).cast("string").alias("timepoint"), L.mouse_cell_type(u).alias("cell_type"))


def heatmap_celltype(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """R8 (T1, A3): (gene, cell_type, log_exp) complete grid."""
    means = S.group_mean(_heat_long(expr, gene_sets, human), ["gene", "cell_type"], "value", "mean_exp")
    # genes of interest x groups: tiny, and read several times by the grid and
    # the matrix statistics, so its lineage is cut once here
    return S.log_matrix(cut_lineage(means), "gene", "cell_type")


def heatmap_from_pseudobulk(pb: DataFrame, units: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """R1 -> R8: the heatmap of a sparse pseudobulk; ``units(unit, cell_type)`` names all units."""
    means = S.zero_filled_mean(S.keep_genes(pb, gene_sets), units, "gene", "cell_type", "mean_exp", "mean_exp")
    return S.log_matrix(cut_lineage(means), "gene", "cell_type")


def heatmap_celltype_timepoint(expr: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """R9 (T1, A4): (gene, cell_sample, log_exp), cell_sample = "<cell type> <timepoint>"."""
    h = _heat_long(expr, gene_sets, True)
    h = h.withColumn("cell_sample", L.composite_key(["cell_type", "timepoint"], sep=" "))
    means = S.group_mean(h, ["gene", "cell_sample"], "value", "mean_exp")
    return S.log_matrix(cut_lineage(means), "gene", "cell_sample")


def corr_genes(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """R10 (T2): gene x gene Pearson r across cell type x timepoint groups (mouse: cell types)."""
    # the matrix (genes of interest x groups) is read three times by the pair statistics
    if human:
        r2 = cut_lineage(heatmap_celltype_timepoint(expr, gene_sets))
        m = A.pearson_matrix(r2, "cell_sample", "gene", "log_exp")
    else:
        r1 = cut_lineage(heatmap_celltype(expr, gene_sets, human=False))
        m = A.pearson_matrix(r1, "cell_type", "gene", "log_exp")
    return m.select(F.col("var_a").alias("gene_a"), F.col("var_b").alias("gene_b"), "corr")


def corr_groups(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """R11 (T2): group x group Pearson r across genes (mouse: cell types)."""
    if human:
        m = A.pearson_matrix(cut_lineage(heatmap_celltype_timepoint(expr, gene_sets)), "gene", "cell_sample", "log_exp")
    else:
        m = A.pearson_matrix(cut_lineage(heatmap_celltype(expr, gene_sets, human=False)), "gene", "cell_type", "log_exp")
    return m.select(F.col("var_a").alias("group_a"), F.col("var_b").alias("group_b"), "corr")


def _distances(matrix: DataFrame, obs: str, var: str, value: str, name: str) -> DataFrame:
    d = A.euclidean_distances(matrix, obs, var, value)
    return d.select(F.col("var_a").alias(f"{name}_a"), F.col("var_b").alias(f"{name}_b"), "distance")


def heatmap_distance(expr: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Euclidean distances between heatmap rows (genes) of R9."""
    return _distances(cut_lineage(heatmap_celltype_timepoint(expr, gene_sets)), "cell_sample", "gene", "log_exp", "gene")


def heatmap_group_distance(expr: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Euclidean distances between heatmap columns (cell type x timepoint groups) of R9."""
    return _distances(cut_lineage(heatmap_celltype_timepoint(expr, gene_sets)), "gene", "cell_sample", "log_exp", "group")


def celltype_heatmap_distance(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """Euclidean distances between heatmap rows (genes) of R8."""
    return _distances(cut_lineage(heatmap_celltype(expr, gene_sets, human)), "cell_type", "gene", "log_exp", "gene")


def celltype_heatmap_group_distance(expr: DataFrame, gene_sets: DataFrame, human: bool = True) -> DataFrame:
    """Euclidean distances between heatmap columns (cell types) of R8."""
    return _distances(cut_lineage(heatmap_celltype(expr, gene_sets, human)), "gene", "cell_type", "log_exp", "group")


def corr_distance(corr: DataFrame, name: str) -> DataFrame:
    """Euclidean distances between the rows of a correlation matrix (R10: gene, R11: group)."""
    return _distances(cut_lineage(corr), f"{name}_b", f"{name}_a", "corr", name)


# ---- R12 - R15 score correlations -----------------------------------------------------------

def sample_score_means(scores: DataFrame, n_lead: int = 3, human: bool = True) -> DataFrame:
    """Mean of both scores per sample."""
    d1 = labelled_wide(scores, human, n_lead, 2)
    return d1.groupBy("sample").agg(F.avg(SET_1).alias("mean_gene1"), F.avg(SET_2).alias("mean_gene2"))


def score_corr_samples(scores: DataFrame, n_lead: int = 3, human: bool = True) -> DataFrame:
    """R12 (T3): Spearman of the per-sample mean scores."""
    return A.spearman(sample_score_means(scores, n_lead, human), [], "mean_gene1", "mean_gene2")


def _d1_filtered(scores: DataFrame, human: bool = True) -> DataFrame:
    # F6; for mouse labels no rule yields "Patient", so it keeps every row (Q16)
    return S.drop_patient_specific(labelled_wide(scores, human, 3, 2))


def score_corr(scores: DataFrame, facets: list[str], human: bool = True) -> DataFrame:
    """R13-R15 (T3): Spearman of unit scores per facet, patient-specific types excluded."""
    return A.spearman(_d1_filtered(scores, human), facets, SET_1, SET_2)


def score_fit(scores: DataFrame, facets: list[str], human: bool = True) -> DataFrame:
    """T4: least-squares line of score 2 on score 1 per facet."""
    return A.linear_fit(_d1_filtered(scores, human), facets, SET_1, SET_2)


def score_fit_samples(scores: DataFrame, n_lead: int = 3, human: bool = True) -> DataFrame:
    """T4 for R12: line through the per-sample mean scores."""
    return A.linear_fit(sample_score_means(scores, n_lead, human), [], "mean_gene1", "mean_gene2")


def score_fit_band(scores: DataFrame, facets: list[str], points: int = 80, human: bool = True) -> DataFrame:
    """T4 band of R13-R15: fitted values and 95% confidence limits on a grid per facet."""
    return A.fit_band(score_fit(scores, facets, human), facets, points)


def score_fit_band_samples(scores: DataFrame, points: int = 80, human: bool = True) -> DataFrame:
    """T4 band of R12."""
    return A.fit_band(score_fit_samples(scores, human=human), [], points)
