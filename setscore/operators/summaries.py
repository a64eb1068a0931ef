"""Grouped summaries behind the reports.

These run on unit-level tables (scores or pseudobulk means), whose size is the
number of pseudobulk groups times sets or genes, never the cell count.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.functions.labels import log_or_zero, not_matching
from setscore.operators import ranks
from setscore.operators.joins import join_on_keys

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NULL_KEY = "\u0000NULL"


def genes_of_interest(gene_sets: DataFrame) -> DataFrame:
    """Distinct genes over all sets."""
    return gene_sets.select("gene").where(F.col("gene").isNotNull()).distinct()


def keep_genes(expr: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """left-semi join on the gene union."""
    return expr.join(genes_of_interest(gene_sets), "gene", "left_semi")


def drop_patient_specific(df: DataFrame, col: str = "cell_type") -> DataFrame:
    """!grepl("Patient", cell_type), which keeps unlabelled rows."""
    return df.where(not_matching(col, "Patient"))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, alias: str, strict: bool = False) -> DataFrame:
    """Unweighted mean per group; NULL keys form groups.

    ``strict`` reproduces R's mean without na.rm: one missing value makes the
    group's mean missing (Spark's avg skips NULL otherwise).
    """
    v = F.col(value)
    mean = F.avg(v)
    if strict:
        mean = F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))
    return df.groupBy(*keys).agg(mean.alias(alias))


def zero_filled_mean(sparse: DataFrame, units: DataFrame, row: str, group: str, value: str, alias: str) -> DataFrame:
    """A3/A4 of a sparse matrix: (row, group, mean over all units of the group, absent cells counting as 0).

    ``sparse(unit, row, value)`` lists the non-zero cells; ``units(unit, group)`` names every unit,
    those without any cell too. Sums are pre-aggregated; nothing is made dense.
    """
    own = units.select("unit", group).distinct()
    sums = sparse.join(own, "unit").groupBy(row, group).agg(F.sum(value).alias("_sum"))
    sizes = own.groupBy(group).agg(F.count(F.lit(1)).alias("_units"))
    return join_on_keys(sums, sizes, [group]).select(row, group, (F.col("_sum") / F.col("_units")).alias(alias))


def key_grid(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every row of ``rows`` with every distinct non-NULL ``key`` of ``keys``.

    Each key gets a dense 0-based index from the distributed positions primitive (no key list passes
    through the driver, only their count); every row then explodes ``sequence(0, count - 1)`` and the
    index joins back to the key. No cross join.
    """
    index = ranks.value_positions(keys.select(key).distinct(), [], key).select(key, F.col("before").alias("_ix"))
    n_keys = index.agg(F.count(F.lit(1))).scalar()
    last = F.when(n_keys > 0, n_keys - 1)
    return rows.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_ix")).join(index, "_ix").drop("_ix")


def complete_grid(df: DataFrame, row: str, col: str, value: str, fill: float | None = None) -> DataFrame:
    """A5: every (row, col) pair of the keys present in ``df``; missing cells -> ``fill``.

    The grid is the output (the dense matrix), built by :func:`key_grid`.
    """
    keyed = df.withColumn(col, F.coalesce(F.col(col), F.lit(_NULL_KEY)))
    grid = key_grid(keyed.select(row).distinct(), keyed, col)
    out = grid.join(keyed.select(row, col, value), [row, col], "left")
    out = out.withColumn(col, F.when(F.col(col) == _NULL_KEY, F.lit(None)).otherwise(F.col(col)))
    if fill is not None:
        out = out.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))
    return out


def log_matrix(means: DataFrame, row: str, col: str, value: str = "mean_exp",
               out: str = "log_exp") -> DataFrame:
    """T1 tail: complete grid, natural log, NaN/Inf/missing -> 0."""
    grid = complete_grid(means, row, col, value)
    return grid.select(row, col, log_or_zero(value).alias(out))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group n, quartiles (type 7, distributed), whiskers at 1.5 IQR, outlier count."""
    v = F.col(value)
    q = ranks.quantiles(df, keys, value, (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    fence_lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    fence_hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = join_on_keys(df.select(*keys, value), q, keys)
    inside = (v >= fence_lo) & (v <= fence_hi)
    w = (j.groupBy(*keys)
          .agg(F.min(F.when(inside, v)).alias("lower"), F.max(F.when(inside, v)).alias("upper"),
               F.count(F.when(~inside, v)).alias("n_outliers")))
    return join_on_keys(q, w, keys)


def box_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows of ``df`` whose value lies beyond their group's fences, the points a box plot draws one
    by one. Fences lie 1.5 IQR from the quartiles; rows without a value are no outliers."""
    q = ranks.quantiles(df, keys, value, (0.25, 0.75), ("_q1", "_q3")).drop("n")
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    beyond = (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)
    return join_on_keys(df, q, keys).where(beyond).select(*df.columns)


# Cells of a density per bandwidth, and the highest moment kept of each.
DENSITY_CELLS = 2
DENSITY_ORDER = 14


def _nrd0(sd: Column, iqr: Column, first_abs: Column, n: Column) -> Column:
    """Silverman's rule of thumb with R's fallbacks (bw.nrd0)."""
    lo = F.least(sd, iqr / 1.34)
    lo = F.when(lo > 0, lo).when(sd > 0, sd).when(first_abs > 0, first_abs).otherwise(F.lit(1.0))
    return 0.9 * lo * F.pow(n.cast("double"), F.lit(-0.2))


def _density_sums(keys: Sequence[str], n_points: int):
    """Per Arrow batch of cells and group: the sums of exp(-u^2 / 2) at the group's grid points, one row each.

    With d the distance of a grid point from the cell's centre and u that of a value, in bandwidths,
    exp(-(d - u)^2 / 2) is the sum of u^k / k! He_k(d) exp(-d^2 / 2) over k; He are Hermite polynomials.
    """
    factorial = np.cumprod(np.maximum(np.arange(DENSITY_ORDER + 1.0), 1.0))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            codes = np.stack([get(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys], axis=1)
            _, first, group = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            step, bw, cell = (get(c).to_numpy(zero_copy_only=False) for c in ("step", "bw", "cell"))
            moments = np.stack([get(f"m{k}").to_numpy(zero_copy_only=False) / factorial[k] for k in range(DENSITY_ORDER + 1)])
            sums = []
            for g, at in enumerate(first):
                own = np.flatnonzero(group.ravel() == g)
                total = np.zeros(n_points)
                for k in range(0, len(own), 512):
                    cells = own[k:k + 512]
                    # beyond 40 bandwidths the kernel is 0
                    d = np.clip(np.subtract.outer(-cell[cells] / DENSITY_CELLS, -(step[at] / bw[at]) * np.arange(n_points)), -40.0, 40.0)
                    before, now = np.zeros_like(d), np.exp(-0.5 * d * d)
                    for order in range(DENSITY_ORDER + 1):
                        total += moments[order][cells] @ now
                        before, now = now, d * now - order * before
                sums.append(total)
            names = [*keys, "lo", "step", "bw", "n"]
            yield pa.RecordBatch.from_arrays([*[get(c).take(pa.array(first)) for c in names], pa.array(sums, type=pa.list_(pa.float64()))],
                                             names=[*names, "sums"])
    return run


def violin_density(df: DataFrame, keys: Sequence[str], value: str, n_points: int = 512) -> DataFrame:
    """Gaussian KDE per group on ``n_points`` between the group's min and max.

    A group is cut into cells of half a bandwidth. Rows become ``DENSITY_ORDER`` + 1 moments of their cell in
    a partial aggregate; grid points are evaluated from cells, whose number doesn't grow with copies of a
    value. What the moments leave out is below 1e-15 of a row's weight. Only moments and vectors of
    ``n_points`` numbers per batch and group are shuffled.
    """
    keys = list(keys)
    v = F.col(value)
    st = (df.groupBy(*keys)
            .agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
            .where(F.col("n") >= 2))
    quart = ranks.quantiles(df, keys, value, (0.25, 0.75), ("_q1", "_q3")).drop("n")
    st = join_on_keys(st, quart, keys)
    bw = _nrd0(F.col("sd"), F.col("_q3") - F.col("_q1"), F.abs(F.col("lo")), F.col("n"))
    st = st.select(*keys, "lo", ((F.col("hi") - F.col("lo")) / float(n_points - 1)).alias("step"), bw.alias("bw"), "n")
    rows = join_on_keys(df.where(v.isNotNull()).select(*keys, v.cast("double").alias("v")), st, keys)
    schema = T.StructType([*st.schema.fields, T.StructField("sums", T.ArrayType(T.DoubleType()))])
    place = (F.col("v") - F.col("lo")) / F.col("bw") * float(DENSITY_CELLS)
    rows = rows.select(*st.columns, F.rint(place).alias("cell"), ((place - F.rint(place)) / float(DENSITY_CELLS)).alias("u"))
    power, moments = F.lit(1.0), []
    for k in range(DENSITY_ORDER + 1):
        moments.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("u")
    sums = rows.groupBy(*st.columns, "cell").agg(*moments).mapInArrow(_density_sums(keys, n_points), schema)
    points = sums.select(*keys, "lo", "step", "bw", "n", F.posexplode("sums").alias("i", "s"))
    dens = points.groupBy(*keys, "i").agg(
        F.first(F.col("lo") + F.col("i") * F.col("step")).alias("x"),
        (F.sum("s") / (F.first("n") * F.first("bw") * F.lit(2.5066282746310002))).alias("density"))
    scaled = F.col("density") / F.max("density").over(Window.partitionBy(*keys))
    return dens.withColumn("scaled", scaled)


def ranking(wide_scores: DataFrame, score_cols: Sequence[str], digits: int = 3,
            tie: str = "unit") -> DataFrame:
    """Order by the first unrounded score (descending, ties by ``tie``), then round."""
    first = score_cols[0]
    ordered = wide_scores.orderBy(F.col(first).desc_nulls_last(), F.col(tie).asc())
    return ordered.select(*[F.round(F.col(c), digits).alias(c) if c in score_cols else F.col(c)
                            for c in wide_scores.columns])
