"""Gene-set scoring (G0-G7): the GSVA statistic as Spark stages.

Input ``expr(unit, gene, value)`` is a long matrix: complete (every gene has a
value in every unit), or sparse with absent values standing for zero, as the
saved pseudobulk is (:func:`score_sparse`, no matrix is completed).
Output ``scores(unit, set_name, score)`` with scores in [-1, 1].

Stages and their shuffles:

* G1 ``gene_stats``      groupBy(gene) with partial aggregation: n, sample sd, least
  value; constant genes dropped, NULL, NaN and infinite values left out. One row per
  gene, joined back by size.
* G2 ``kernel_cdf``      z_gu = (1/n) sum_k Phi((x_gu - x_gk) / h_g), h_g = sd_g / 4,
  in time linear in the rows, by Taylor expansion per cell of half a bandwidth (see
  :func:`cell_expansions`). Rows become moments of their cell in a partial aggregate;
  only cells are translated; a row's z is one polynomial, evaluated in the JVM.
* W4/G3 ``rank_genes``   window over unit; position by z descending (ties: gene),
  weight r = |p - pos + 1 - p/2| ** tau.
* G4/G5 ``walk_scores``  hits only: with m set genes at positions l_1 < ... < l_m,
  W_k the normalised running weight and pen_k = (l_k - k)/(p - m), the walk's
  extremes are max_k(W_k - pen_k) and min_k(W_{k-1} - pen_k); the score is
  max(0, hi) + min(0, lo). Work per (unit, set) is m rows, not p.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.functions import stats as normal
from setscore.operators.joins import work_partitions
from setscore.session import cut_lineage

# The cells' expansions are translated in Python workers. Pickle these modules'
# functions by value so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(normal)

# z is rounded before ranking so that last-bit differences in the summation
# order (partitioning, engine) cannot reorder genes.
Z_DIGITS = 9

# Expansions: a cell is CELL bandwidths wide; terms up to ORDER. Two points of two
# cells lie within CELL of their centres' distance, so the first term left out is at
# most 0.44 * CELL ** 21 / sqrt(21 * 21!) < 7e-18 of a source (Cramer's bound on
# Hermite functions). Beyond REACH cells (9 bandwidths) Phi is 0 or 1 to 1e-18.
CELL = 0.5
ORDER = 20
REACH = 18
_MOMENTS = [f"m{i}" for i in range(ORDER + 1)]
_COEFFICIENTS = [f"c{i}" for i in range(ORDER + 1)]


def _present(expr: DataFrame) -> DataFrame:
    """Rows with a number: a NULL, NaN or infinite value takes no part in its gene's distribution."""
    return expr.where(_is_number("value"))


def _is_number(value: str) -> Column:
    return F.coalesce(F.abs(F.col(value)) < float("inf"), F.lit(False))


def gene_stats(expr: DataFrame, units: Column | None = None) -> DataFrame:
    """G1: (gene, n, sd, h, lo, zeros) for genes that vary across units.

    ``units``, the number of all units, makes the rows sparse: every unit that a gene has no row of
    counts as a value of zero. ``zeros`` is how many there are. NULL values are absent, NaN and
    infinite ones take no part.
    """
    ok = _is_number("value")
    value = F.when(ok, F.col("value"))
    absent = F.lit(0).cast("long") if units is None else units - F.count("value")
    s = expr.groupBy("gene").agg(F.count(value).alias("k"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"),
                                 F.min(value).alias("least"), absent.alias("zeros"))
    n, k, z = F.col("k") + F.col("zeros"), F.col("k").cast("double"), F.col("zeros").cast("double")
    # squared deviations of the rows and of a block of zeros, about their common mean
    spread = F.coalesce(F.col("var") * k + F.when(z > 0, F.col("mean") * F.col("mean") * (k * z / n)).otherwise(0.0), F.lit(0.0))
    sd = F.sqrt(F.try_divide(spread, n - 1))
    least = F.when(F.col("zeros") > 0, F.least(F.col("least"), F.lit(0.0))).otherwise(F.col("least"))
    s = s.select("gene", n.alias("n"), sd.alias("sd"), (sd / 4.0).alias("h"), least.alias("lo"), "zeros")
    return s.where((F.col("sd") > 0) & (F.col("h") > 0) & (F.col("sd") < float("inf")))


def _placed(value: Column) -> tuple[Column, Column]:
    """A value's cell, and its offset from the cell's centre in bandwidths (-CELL/2 to CELL/2)."""
    scaled = (value - F.col("lo")) / F.col("h")
    cell = F.floor(scaled / CELL)
    return cell, scaled - (cell + 0.5) * CELL


def _powers(u: Column, weight: Column) -> list[Column]:
    """weight * u ** i for i = 0 .. ORDER."""
    out = [weight]
    for _ in range(ORDER):
        out.append(out[-1] * u)
    return out


def translations() -> np.ndarray:
    """(2 REACH + 1, ORDER + 1, ORDER + 1): for a target cell d cells above a source cell, the
    factors that turn the source's moments mu_i into the target's coefficients.

    sum_k Phi(T + v - u_k), T = d * CELL, expanded in v - u: the coefficient of v ** j is
    sum_i Phi^(i+j)(T) / (i! j!) (-1) ** i mu_i, with Phi^(m)(T) = (-1) ** (m-1) He_(m-1)(T) phi(T).
    """
    t = np.arange(-REACH, REACH + 1) * CELL
    derivative = np.zeros((ORDER + 1, len(t)))
    derivative[0] = normal.phi_np(t)
    he = [np.ones_like(t), t]
    for m in range(1, ORDER):
        he.append(t * he[m] - m * he[m - 1])
    density = np.exp(-0.5 * t * t) / normal.ROOT_2PI
    for m in range(1, ORDER + 1):
        derivative[m] = (-1) ** (m - 1) * he[m - 1] * density
    out = np.zeros((len(t), ORDER + 1, ORDER + 1))
    for j in range(ORDER + 1):
        for i in range(ORDER + 1 - j):
            out[:, j, i] = derivative[i + j] * (-1) ** i / (math.factorial(i) * math.factorial(j))
    return out


def _translate(cells: np.ndarray, moments: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Coefficients of every cell from the moments of all, cells ascending."""
    out = np.zeros_like(moments)
    # all sources that lie more than REACH cells below count whole
    below = np.concatenate([[0.0], np.cumsum(moments[:, 0])])
    out[:, 0] = below[np.searchsorted(cells, cells - REACH)]
    for d in range(-REACH, REACH + 1):
        source = np.searchsorted(cells, cells - d)
        hit = np.flatnonzero((source < len(cells)) & (cells[np.minimum(source, len(cells) - 1)] == cells - d))
        out[hit] += moments[source[hit]] @ table[d + REACH].T
    return out


def _expand(batches):
    """Moments to coefficients, gene by gene; rows come by gene and cell, and a gene may go on in the next batch."""
    table = translations()
    held = None

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        genes, cells, moments = pdf["gene"].to_numpy(), pdf["cell"].to_numpy(np.int64), pdf[_MOMENTS].to_numpy(np.float64)
        starts = np.flatnonzero(np.concatenate([[True], genes[1:] != genes[:-1]]))
        found = [_translate(cells[a:b], moments[a:b], table) for a, b in zip(starts, [*starts[1:], len(genes)], strict=True)]
        out = pd.DataFrame(np.concatenate(found), columns=_COEFFICIENTS)
        out.insert(0, "cell", cells)
        out.insert(0, "gene", genes)
        return out

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf["gene"] == pdf["gene"].iloc[-1]).to_numpy()
        held, whole = pdf[last], pdf[~last]
        if len(whole):
            yield done(whole)
    if held is not None:
        yield done(held)


def cell_expansions(expr: DataFrame, stats: DataFrame, partitions: int | None = None) -> DataFrame:
    """(cell_gene, cell_no, c0 ... c20): per gene and cell the polynomial in a value's offset that sums
    the kernel over all of the gene's values; the gene's zeros are one weighted value.

    A gene has few cells: its values span at most sd * sqrt(2 n), so no more than 8 * sqrt(2 n) + 1,
    whatever their distribution. One task takes the cells of a gene; rows are only ever pre-aggregated.
    """
    cell, u = _placed(F.col("value"))
    rows = _present(expr).join(stats.select("gene", "h", "lo"), "gene").select("gene", cell.alias("cell"), u.alias("u"), F.lit(1.0).alias("w"))
    zero_cell, zero_u = _placed(F.lit(0.0))
    zeros = stats.where(F.col("zeros") > 0).select("gene", zero_cell.alias("cell"), zero_u.alias("u"), F.col("zeros").cast("double").alias("w"))
    powers = _powers(F.col("u"), F.col("w"))
    moments = rows.unionByName(zeros).groupBy("gene", "cell").agg(*[F.sum(p).alias(m) for p, m in zip(powers, _MOMENTS, strict=True)])
    kind = T.StructType([moments.schema["gene"], moments.schema["cell"], *[T.StructField(c, T.DoubleType()) for c in _COEFFICIENTS]])
    # few bytes and much work for each: as many tasks as the cluster runs
    spread = moments.repartition(partitions or work_partitions(expr), "gene").sortWithinPartitions("gene", "cell")
    return spread.mapInPandas(_expand, kind).withColumnsRenamed({"gene": "cell_gene", "cell": "cell_no"})


def _horner() -> Column:
    out = F.col(_COEFFICIENTS[-1])
    for c in reversed(_COEFFICIENTS[:-1]):
        out = out * F.col("u") + F.col(c)
    return out


def _evaluated(rows: DataFrame, expansions: DataFrame) -> DataFrame:
    """``rows`` (gene, value, n, h, lo, ...) with z."""
    cell, u = _placed(F.col("value"))
    rows = rows.withColumns({"cell": cell, "u": u})
    found = rows.join(expansions, (F.col("gene") == F.col("cell_gene")) & (F.col("cell") == F.col("cell_no")))
    return found.withColumn("z", _horner() / F.col("n"))


def kernel_cdf(expr: DataFrame, stats: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(unit, gene, z) Gaussian-kernel CDF of each value within its gene."""
    stats = gene_stats(expr) if stats is None else stats
    expansions = cell_expansions(expr, stats, partitions)
    # one row per gene: adaptive execution broadcasts it while it is small
    rows = _present(expr).join(stats, "gene")
    return _evaluated(rows, expansions).select("unit", "gene", "z")


def rank_genes(z: DataFrame, tau: float = 1.0) -> DataFrame:
    """W4 + G3: (unit, gene, pos, p, r) with pos 1 = highest z in the unit."""
    by_unit = Window.partitionBy("unit")
    order = Window.partitionBy("unit").orderBy(F.round("z", Z_DIGITS).desc(), F.col("gene").asc())
    ranked = (z.withColumn("pos", F.row_number().over(order))
               .withColumn("p", F.count(F.lit(1)).over(by_unit)))
    w = F.abs(F.col("p") - F.col("pos") + 1 - F.col("p") / 2.0)
    return ranked.withColumn("r", w if tau == 1.0 else F.pow(w, F.lit(float(tau))))


def walk_scores(ranked: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """G4 + G5: (unit, set_name, score) from the hits of each set only."""
    sets = gene_sets.select("set_name", "gene").distinct()
    hits = ranked.join(sets, "gene")
    grp = Window.partitionBy("unit", "set_name")
    run = grp.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.row_number().over(grp.orderBy("pos"))
    total = F.sum("r").over(grp)
    m = F.count(F.lit(1)).over(grp)
    walk = (hits.withColumn("k", k).withColumn("m", m)
                .withColumn("cr", F.sum("r").over(run)).withColumn("tot", total))
    pen = F.coalesce(F.try_divide(F.col("pos") - F.col("k"), F.col("p") - F.col("m")), F.lit(0.0))
    # Walk just after hit k (its high) and just before it (its low). Units with
    # the same hit positions get bit-identical scores, so ties stay ties.
    dev = walk.select("unit", "set_name", (F.try_divide(F.col("cr"), F.col("tot")) - pen).alias("hi"),
                      (F.try_divide(F.col("cr") - F.col("r"), F.col("tot")) - pen).alias("lo"))
    agg = dev.groupBy("unit", "set_name").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    score = F.greatest(F.col("hi"), F.lit(0.0)) + F.least(F.col("lo"), F.lit(0.0))
    return agg.select("unit", "set_name", F.coalesce(score, F.lit(0.0)).alias("score"))


def rank_matrix(expr: DataFrame, tau: float = 1.0) -> DataFrame:
    """(unit, gene, z, pos, p, r), independent of any gene set.

    Persist or checkpoint it to score many gene-set tables with
    :func:`walk_scores` alone.
    """
    return rank_genes(kernel_cdf(expr), tau)


def score_gene_sets(expr: DataFrame, gene_sets: DataFrame, tau: float = 1.0) -> DataFrame:
    """GSVA scores (unit, set_name, score) of every set against a complete matrix.

    Set genes missing from the matrix are ignored; a set with no gene in the
    matrix yields no rows.
    """
    return walk_scores(rank_matrix(expr, tau), gene_sets)


def _by_score() -> list[Column]:
    """The order of genes: highest rounded z first, then by name."""
    return [F.col("zr").desc(), F.col("gene").asc()]


def _zeros_before(zero: DataFrame, present: DataFrame) -> DataFrame:
    """(zr, gene, unit, before): for each row of ``present`` (unit, gene, zr), and with a NULL unit for
    each of ``zero`` (gene, zr), how many of the genes in ``zero`` come before it (a row's own gene too).

    One range sort of both; the ranges are written, so that counts and offsets come from the same.
    """
    both = zero.select("zr", "gene", F.lit(None).cast("string").alias("unit"), F.lit(1).alias("mark")).unionByName(
        present.select("zr", "gene", "unit", F.lit(0).alias("mark")))
    order = [*_by_score(), F.col("mark").desc(), F.col("unit").asc()]
    ranges = cut_lineage(both.repartitionByRange(work_partitions(zero), *order).withColumn("part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = ranges.groupBy("part").agg(F.sum("mark").alias("marks")).select(
        F.col("part").alias("of"), F.coalesce(F.sum("marks").over(earlier(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("offset"))
    here = F.coalesce(F.sum("mark").over(earlier(Window.partitionBy("part").orderBy(*order))), F.lit(0))
    return ranges.withColumn("here", here).join(offsets, F.col("part") == F.col("of")).select("zr", "gene", "unit", (F.col("here") + F.col("offset")).alias("before"))


def rank_sparse(expr: DataFrame, genes: DataFrame, tau: float = 1.0) -> DataFrame:
    """G1-G3 of a sparse matrix: (unit, gene, pos, p, r) of every row of ``expr`` (unit, gene, value), and
    of ``genes`` where a unit has no row of them. Absent values stand for zero; nothing is completed.

    A gene's zeros are one weighted value in its kernel and share one z. So all units order their zeros
    alike: by one list of genes. In a unit, a gene's position is its place among the unit's own rows and
    the zeros before it: those of the list, less the list's genes that the unit has rows of. One window
    over a unit's rows, each in its own place and in its gene's place on the list, counts both.

    The work is that of the rows, and of units x ``genes``. A NULL value is absent; a NaN or infinite one
    leaves its gene out of its unit. Units are those with any row.
    """
    from setscore.operators.summaries import key_grid
    units = expr.select("unit").distinct()
    listed = expr.where(F.col("value").isNotNull())
    stats = cut_lineage(gene_stats(listed, units.agg(F.count(F.lit(1))).scalar()))
    expansions = cut_lineage(cell_expansions(listed, stats))
    rounded = F.round("z", Z_DIGITS)
    present = _evaluated(_present(listed).join(stats, "gene"), expansions).select("unit", "gene", rounded.alias("zr"))
    zero = _evaluated(stats.where(F.col("zeros") > 0).withColumn("value", F.lit(0.0)), expansions).select("gene", rounded.alias("zr"))
    placed = cut_lineage(_zeros_before(zero, present))
    rows = placed.where(F.col("unit").isNotNull())
    zero = placed.where(F.col("unit").isNull()).select("gene", "zr", "before")

    none, nothing = F.lit(0), F.lit(None).cast("long")
    kinds = lambda kind, x, y, void, before: [kind.alias("kind"), x.alias("x"), y.alias("y"), void.alias("void"), before.alias("before")]
    own = rows.select("unit", "gene", "zr", *kinds(none + 1, none + 1, none, none, F.col("before")))
    # a listed value takes its gene off the unit's list of zeros, and out of the unit if it is no number
    varying = stats.select("gene").join(zero.select(F.col("gene").alias("zero_gene"), "zr"), F.col("gene") == F.col("zero_gene"), "left")
    off = listed.join(varying, "gene").select("unit", "gene", "zr", *kinds(
        none, none, F.col("zr").isNotNull().cast("int"), (~_is_number("value")).cast("int"), nothing))
    asked = zero.join(genes.select("gene").distinct(), "gene", "left_semi")
    absent = key_grid(units, asked.select("gene"), "gene").join(listed.select("unit", "gene"), ["unit", "gene"], "left_anti").join(asked, "gene")
    absent = absent.select("unit", "gene", "zr", *kinds(none + 2, none, none, none, F.col("before")))

    by_unit = Window.partitionBy("unit")
    run = by_unit.orderBy(*_by_score(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = stats.agg(F.count(F.lit(1))).scalar() - F.sum("void").over(by_unit)
    ranked = own.unionByName(off).unionByName(absent).withColumns({
        "xs": F.sum("x").over(run), "ys": F.sum("y").over(run), "p": p})
    pos = F.col("xs") + F.col("before") - F.col("ys") + (F.col("kind") == 2).cast("int")
    ranked = ranked.where(F.col("kind") > 0).withColumn("pos", pos)
    w = F.abs(F.col("p") - F.col("pos") + 1 - F.col("p") / 2.0)
    return ranked.select("unit", "gene", "pos", "p", (w if tau == 1.0 else F.pow(w, F.lit(float(tau)))).alias("r"))


def score_sparse(expr: DataFrame, gene_sets: DataFrame, tau: float = 1.0) -> DataFrame:
    """G0 on a sparse matrix, such as the saved pseudobulk: equal to :func:`score_gene_sets` of the
    matrix completed with zeros."""
    return walk_scores(rank_sparse(expr, gene_sets, tau), gene_sets)


def scores_wide(scores: DataFrame, set_names: list[str]) -> DataFrame:
    """One row per unit, one column per named set (NULL where absent)."""
    return (scores.groupBy("unit").pivot("set_name", set_names)
                  .agg(F.first("score")))
