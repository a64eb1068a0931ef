"""Pseudobulk aggregation.

``counts(gene, cell_id, value)`` holds the non-zero entries of a gene x cell
matrix; ``cells(cell_id, ...)`` the cell metadata. A unit is the space-free
composite key of the chosen metadata columns plus ``_<cell_count>``. The mean
counts every cell of the unit, zeros included: ``sum(value) / cell_count``
with the sum over the sparse triples and ``cell_count`` from ``cells`` alone.
A cell without triples is an all-zero cell that still counts.

Plan: one shuffle of counts on ``cell_id`` (or a broadcast of the cell keys
when AQE sees a small side), a partial + final aggregate on (stem, gene) and a
join of the small per-unit size table. Hot units are absorbed by the map-side
partial aggregate; no cell or unit is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscore.functions.labels import composite_key, has_no_dot_or_dash, normalise_cluster, remove_spaces

# Key columns of the three reference builds.
HUMAN_KEYS = ("cluster", "response", "timepoint", "ident", "patient")
MOUSE_ALL_KEYS = ("cell_type", "sample")
MOUSE_MALIGNANT_KEYS = ("ident", "cluster")


def keyed_cells(cells: DataFrame, key_cols: Sequence[str], filter_col: str | None = None,
                normalise: bool = False) -> DataFrame:
    """F2 + P9 + L4: (cell_id, stem) for cells whose filter column is set."""
    filter_col = filter_col or key_cols[0]
    c = cells.where(F.col(filter_col).isNotNull())
    if normalise and "cluster" in key_cols:
        c = c.withColumn("cluster", normalise_cluster("cluster"))
    return c.select("cell_id", remove_spaces(composite_key(list(key_cols))).alias("stem"))


def unit_sizes(keyed: DataFrame) -> DataFrame:
    """A2: (stem, unit, cell_count); the count is folded into the unit name."""
    sizes = keyed.groupBy("stem").agg(F.count(F.lit(1)).alias("cell_count"))
    unit = F.concat(F.col("stem"), F.lit("_"), F.col("cell_count").cast("string"))
    return sizes.select("stem", unit.alias("unit"), "cell_count")


def pseudobulk(counts: DataFrame, cells: DataFrame, key_cols: Sequence[str] = HUMAN_KEYS,
               filter_col: str | None = None, gene_allowlist: DataFrame | None = None,
               drop_dot_dash_genes: bool = False, normalise: bool = False, hash_cells: bool = False) -> DataFrame:
    """A1: (gene, unit, mean_exp, cell_count), one row per (gene, unit) with a triple.

    * ``gene_allowlist`` (F1): one-column ``gene`` frame; a left-semi join before aggregation.
    * ``drop_dot_dash_genes`` (F4): off by default, as the reference saves the uncleaned matrix.
    * ``normalise`` (L9): rewrite cluster names before building keys.
    * ``hash_cells``: J1 hashes a partition's share of the cells and streams its counts, unsorted. For
      counts that are dealt by ``cell_id`` already and have many rows a cell.
    """
    keyed = keyed_cells(cells, key_cols, filter_col, normalise)
    if gene_allowlist is not None:
        counts = counts.join(gene_allowlist.select("gene").distinct(), "gene", "left_semi")
    if drop_dot_dash_genes:
        counts = counts.where(has_no_dot_or_dash("gene"))
    # Counts carry no unit, so the join precedes the aggregate. Without
    # hash_cells the cell side is left to the planner: AQE broadcasts it when small, else both sides
    # shuffle on cell_id, which is never hot (one cell has at most one row per gene).
    sums = (counts.join(keyed.hint("shuffle_hash") if hash_cells else keyed, "cell_id")
                  .groupBy("stem", "gene").agg(F.sum("value").alias("s")))
    # unit_sizes has one row per unit: AQE turns this into a broadcast join from
    # the measured shuffle size, and keeps the sort-merge join otherwise.
    return (sums.join(unit_sizes(keyed), "stem")
                .select("gene", "unit", (F.col("s") / F.col("cell_count")).alias("mean_exp"), "cell_count"))


def complete_matrix(pb: DataFrame) -> DataFrame:
    """A5 for scoring: (unit, gene, value) over every gene x unit, absent means as 0.

    The pseudobulk lists non-zero means only; the reference's matrix is dense.
    Units are bounded by the number of metadata groups; their set is gathered
    once and exploded per gene (no cross join).
    """
    from setscore.operators.summaries import complete_grid
    grid = complete_grid(pb.select("gene", "unit", "mean_exp"), "gene", "unit", "mean_exp", fill=0.0)
    return grid.select("unit", "gene", F.col("mean_exp").alias("value"))
