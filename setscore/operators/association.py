"""Association statistics.

Ranks, moments and sums run as Spark aggregates; only one row per facet
reaches a tail function. p-values:

* T3 Spearman, two-sided: without ties the null distribution of S, the sum of
  squared rank differences, up to n = 9 by counting permutations and below
  n = 1,290 by its Edgeworth series; with ties or beyond, t = r * sqrt((n - 2) /
  (1 - r^2)), df n - 2. The Student tail is integrated with a fixed number of
  nodes, whatever df.
* T5 Wilcoxon rank-sum: normal approximation with tie and continuity
  correction; the exact null distribution (both groups < 50, no ties) comes
  from a per-facet counting recursion in :func:`wilcoxon_p`.
* T2 and T8 pair statistics: block tiles of variables and observations.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.functions.stats import phi
from setscore.operators import ranks
from setscore.operators.joins import join_on_keys

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """W6, see :func:`setscore.operators.ranks.mid_rank`."""
    return ranks.mid_rank(df, keys, value, out)


# Gauss-Legendre nodes and weights on [0, 1].
_NODES = [((x + 1) / 2, w / 2) for x, w in zip(*np.polynomial.legendre.leggauss(64), strict=True)]
_CUT = 41.0        # the tail is cut where the density has fallen by exp(-41)


def _log_cosh(u: Column) -> Column:
    return F.log1p(F.sinh(u) * F.sinh(u)) / 2


def _falling_integral(start: Column | float, nu: Column) -> Column:
    """Integral of (cosh(u) / cosh(start)) ** -nu from ``start`` on, by 64 nodes whatever ``nu``."""
    start = F.lit(start) if isinstance(start, float) else start
    width = F.acosh(F.cosh(start) * F.exp(_CUT / nu)) - start
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in _NODES])
    return width * F.aggregate(nodes, F.lit(0.0), lambda acc, k: acc + k["w"] * F.exp(
        -nu * (_log_cosh(start + width * k["x"]) - _log_cosh(start))))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail for df >= 1 (NULL when df < 1).

    With t = sqrt(df) sinh(u) the density is proportional to cosh(u) ** -df, so the tail is a
    quotient of two integrals; the work is the same for every df.
    """
    nu = df.cast("double")
    start = F.asinh(F.abs(t) / F.sqrt(nu))
    p = F.exp(-nu * _log_cosh(start)) * _falling_integral(start, nu) / _falling_integral(0.0, nu)
    return F.when(df >= 1, F.when(F.isnan(t) | (F.abs(t) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), p)))


def t_quantile(p: float, df: Column) -> Column:
    """Upper quantile of Student t (p > 0.5; NULL when df < 1): 52 halvings of atan(t / sqrt(df))."""
    root = F.sqrt(df.cast("double"))
    widths = [math.pi / 2 ** k for k in range(2, 54)]
    angle = F.aggregate(F.array(*map(F.lit, widths)), F.lit(0.0), lambda lo, w: lo + F.when(
        t_two_sided_p(root * F.tan(lo + w), df) > 2 * (1 - p), w).otherwise(0.0))
    return F.when(df >= 1, root * F.tan(angle))


def _corr(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Guarded correlation from centred sums: NULL on zero variance (no error)."""
    return F.try_divide(sxy, F.sqrt(sxx * syy))


# Fixed values of the reference's rule: where permutations are counted, where the series ends,
# and the constants c1 ... c12 of the series (algorithm AS 89).
COUNTED_UP_TO, SERIES_BELOW = 9, 1_290
SERIES = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)


def spearman_counts(n: int) -> list[int]:
    """Permutations of n by S / 2, S the (even) sum of squared differences from the identity: one
    position after another, by the set of values used so far."""
    states = {0: {0: 1}}
    for k in range(n):
        after: dict[int, dict[int, int]] = {}
        for mask, sums in states.items():
            for j in range(n):
                if not mask >> j & 1:
                    to = after.setdefault(mask | 1 << j, {})
                    for d, c in sums.items():
                        to[d + (k - j) ** 2] = to.get(d + (k - j) ** 2, 0) + c
        states = after
    found = states[(1 << n) - 1]
    return [found.get(d, 0) for d in range(0, n * (n * n - 1) // 3 + 1, 2)]


def _counted_tail(n: Column, s: Column) -> Column:
    """P(S <= s) for 2 <= n <= COUNTED_UP_TO, s even."""
    tables = []
    for k in range(2, COUNTED_UP_TO + 1):
        tables.append(F.array(*[F.lit(float(x)) for x in np.cumsum(spearman_counts(k)) / math.factorial(k)]))
    table = F.element_at(F.array(*tables), (n - 1).cast("int"))
    return F.element_at(table, (s / 2).cast("int") + 1)


def _with_spearman_p(found: DataFrame) -> DataFrame:
    """``found`` (n, r, _ties, ...) with p and p_method: ``exact``, ``edgeworth`` or ``t``."""
    n, r, s, x, y, b = (F.col(c) for c in ("_n", "r", "_s", "_x", "_y", "_b"))
    exact, series = ~F.col("_ties") & (F.col("n") <= COUNTED_UP_TO), ~F.col("_ties") & (F.col("n") < SERIES_BELOW)
    method = F.when(r.isNull() | F.isnan(r), F.lit(None)).when(exact, "exact").when(series, "edgeworth").when(F.col("n") >= 3, "t")
    # steps of their own, so that none is spelled out again wherever it is used
    out = found.withColumns({"p_method": method, "_n": F.col("n").cast("double")})
    out = out.withColumns({"_all": (n * n * n - n) / 3, "_b": 1.0 / n})         # S of the reversed order
    out = out.withColumn("_s", 2 * F.round(F.col("_all") * (1 - r) / 4))
    out = out.withColumn("_s", F.least(s, F.col("_all") - s))                   # S is distributed symmetrically
    # P(S <= s) by the Edgeworth series, taken midway to the next value
    out = out.withColumn("_x", F.try_divide(6.0 * (s + 1) * b, n * n - 1.0) * F.sqrt(n - 1.0) - F.sqrt(n - 1.0))
    out = out.withColumn("_y", x * x)
    c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12 = SERIES
    u = x * b * (c1 + b * (c2 + c3 * b) + y * (-c4 + b * (c5 + c6 * b) - y * b * (c7 + c8 * b - y * (c9 - c10 * b + y * b * (c11 - c12 * y)))))
    tail = (F.when(F.col("p_method") == "exact", _counted_tail(F.col("n"), s))
             .when(F.col("p_method") == "edgeworth", F.greatest(F.lit(0.0), phi(x) - u * F.exp(y * -0.5))))
    t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    out = out.withColumns({"_tail": tail, "_t": F.when(F.col("p_method") == "t", t)})
    by_t = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(t_two_sided_p(F.col("_t"), F.col("n") - 2))
    p = F.when(F.col("p_method") == "t", by_t).when(F.col("_tail") > 0.5, 1.0).otherwise(2 * F.col("_tail")).cast("double")
    return out.withColumn("p", p).drop("_n", "_all", "_b", "_s", "_x", "_y", "_tail", "_t", "_ties")


def spearman(df: DataFrame, facets: Sequence[str], x: str, y: str) -> DataFrame:
    """Per facet n, Spearman r, its two-sided p and p_method. Rows without both values are left out;
    a constant column, or a single row, has no r, p or method."""
    facets = list(facets)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranks.mid_ranks(d.select(*facets, x, y), facets, {x: "_rx", y: "_ry"})
    m = ranked.groupBy(*facets).agg(F.count(F.lit(1)).alias("n"),
                                    F.regr_sxy("_ry", "_rx").alias("sxy"),
                                    F.regr_sxx("_ry", "_rx").alias("sxx"),
                                    F.regr_syy("_ry", "_rx").alias("syy"))
    r = _corr(F.col("sxy"), F.col("sxx"), F.col("syy"))
    # a tie of t takes (t^3 - t) / 12, a half at least, from the squares of the ranks 1 ... n
    size = F.col("n").cast("double")
    ties = F.least("sxx", "syy") < (size * size * size - size) / 12 - 0.25
    out = _with_spearman_p(m.select(*facets, "n", r.alias("r"), ties.alias("_ties")))
    return out.select(*facets, "n", "r", "p", "p_method")


def linear_fit(df: DataFrame, facets: Sequence[str], x: str, y: str) -> DataFrame:
    """T4 coefficients: per facet n, slope, intercept, residual sd, x mean and Sxx."""
    facets = list(facets)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = d.groupBy(*facets).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("xbar"),
        F.min(x).alias("xmin"), F.max(x).alias("xmax"))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma = F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss, F.col("n") - 2)))
    return m.select(*facets, "n", "slope", "intercept", sigma.alias("sigma"), "xbar", "sxx", "xmin", "xmax")


def fit_band(fit: DataFrame, facets: Sequence[str], points: int = 80) -> DataFrame:
    """T4 band: fitted line and 95% confidence band on ``points`` x positions per facet."""
    facets = list(facets)
    withq = fit.withColumn("tq", t_quantile(0.975, F.col("n") - 2))
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    g = withq.select("*", i)
    xg = F.col("xmin") + (F.col("xmax") - F.col("xmin")) * F.col("i") / float(points - 1)
    yhat = F.col("intercept") + F.col("slope") * F.col("x")
    se = F.col("sigma") * F.sqrt(1.0 / F.col("n") + F.pow(F.col("x") - F.col("xbar"), 2) / F.col("sxx"))
    g = g.withColumn("x", xg)
    return g.select(*facets, "i", "x", yhat.alias("fit"), (yhat - F.col("tq") * se).alias("lower"),
                    (yhat + F.col("tq") * se).alias("upper"))


def wilcoxon(df: DataFrame, facets: Sequence[str], group: str, value: str,
             levels: tuple[str, str]) -> DataFrame:
    """T5 statistic and normal-approximation p per facet.

    ``levels`` = (x group, y group); W = rank sum of x - n1(n1+1)/2. Rows with
    other or NULL groups are ignored; a facet without both groups gets NULLs.
    """
    facets = list(facets)
    d = df.where(F.col(group).isin(*levels) & F.col(value).isNotNull())
    r = mid_rank(d, facets, value, "_r")
    is_x = F.col(group) == levels[0]
    ties = d.groupBy(*facets, value).agg(F.count(F.lit(1)).alias("t"))
    tie_sum = ties.groupBy(*facets).agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie"))
    m = r.groupBy(*facets).agg(F.sum(F.when(is_x, F.col("_r"))).alias("rx"),
                               F.count(F.when(is_x, 1)).alias("n1"),
                               F.count(F.when(~is_x, 1)).alias("n2"))
    m = join_on_keys(m, tie_sum, facets)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    w = F.col("rx") - n1 * (n1 + 1) / 2
    z0 = w - n1 * n2 / 2
    sigma = F.sqrt((n1 * n2 / 12) * ((n1 + n2 + 1) - F.try_divide(F.col("tie"), (n1 + n2) * (n1 + n2 - 1))))
    # a column of its own: written out at each of its uses, it is more code than a method may have
    m = m.withColumn("_z", F.try_divide(z0 - F.signum(z0) * 0.5, sigma)).withColumn("_below", phi(F.col("_z")))
    p = 2 * F.least(F.col("_below"), 1 - F.col("_below"))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0)
    return m.select(*facets, "n1", "n2",
                    F.when(ok, w).alias("w"),
                    F.when(ok, F.least(F.lit(1.0), p)).alias("p_normal"),
                    (F.col("tie") > 0).alias("has_ties"))


def _pwilcox_counts(n1: int, n2: int) -> np.ndarray:
    """Number of arrangements giving each U = 0..n1*n2 (Mann-Whitney recursion)."""
    # f[i][j] = counts for i x-values and j y-values, as a polynomial in U.
    prev = [np.ones(1, dtype=float) for _ in range(n2 + 1)]   # i = 0
    for i in range(1, n1 + 1):
        cur = [np.ones(1, dtype=float)]                        # j = 0: U = 0 only
        for j in range(1, n2 + 1):
            a = cur[j - 1]                  # last element is x... shifted below
            b = prev[j]
            size = i * j + 1
            out = np.zeros(size)
            # last of i+j sorted values is a y (U unchanged) or an x (U += j)
            out[: a.size] += a
            out[j: j + b.size] += b
            cur.append(out)
        prev = cur
    return prev[n2]


def _exact_p(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two-sided p of each facet's w from the null distribution of its group sizes, which a task works out
    once for each pair of sizes."""
    known: dict[tuple[int, int], np.ndarray] = {}
    for pdf in batches:
        out = []
        for n1, n2, w in zip(pdf["n1"], pdf["n2"], pdf["w"], strict=True):
            sizes = (int(min(n1, n2)), int(max(n1, n2)))
            if sizes not in known:
                counts = _pwilcox_counts(*sizes)
                known[sizes] = np.cumsum(counts) / counts.sum()
            cdf, q = known[sizes], int(round(w))
            out.append(min(1.0, 2 * (1 - cdf[q - 1] if q > n1 * n2 / 2 else cdf[q])))
        yield pdf.assign(p=out)


# Fixed value: groups below this size have an exact p by the reference's rule.
EXACT_BELOW = 50


def wilcoxon_p(stats: DataFrame, facets: Sequence[str], p_method: str = "reference") -> DataFrame:
    """T5: ``stats`` with p and the method that gave it, p_method.

    ``normal``: the corrected normal approximation. ``reference``: the exact null distribution for
    facets without ties whose groups are both below 50, the normal approximation for the rest.
    A facet that lacks a group has no test: p and p_method are NULL.
    """
    if p_method not in ("normal", "reference"):
        raise ValueError(f"unknown p_method {p_method!r}")
    tested = F.col("w").isNotNull()
    exact = (tested & ~F.col("has_ties") & (F.col("n1") < EXACT_BELOW) & (F.col("n2") < EXACT_BELOW)
             if p_method == "reference" else F.lit(False))
    marked = stats.withColumn("p_method", F.when(exact, "exact").when(tested, "normal"))
    normal = marked.where(~F.coalesce(exact, F.lit(False))).withColumn("p", F.col("p_normal"))
    if p_method == "normal":
        return normal
    schema = T.StructType([*marked.schema.fields, T.StructField("p", T.DoubleType())])
    return marked.where(exact).mapInPandas(_exact_p, schema).unionByName(normal)


# Sides of a tile of the pair statistics: variables of a block, observations of a chunk.
BLOCK_VARIABLES = 512
CHUNK_OBSERVATIONS = 4_096
_NULL_VARIABLE = "\u0000NULL"


def _tile_pairs(square: bool):
    """Kernel of one tile: (a, b, s, n, shared) of its pairs of variables, a <= b by value. s sums the
    products (``square``: squared differences) over observations that both have a value for, n counts
    them, and shared counts those that both have a row for."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, v = np.unique(pdf["v"].to_numpy(), return_inverse=True)
        o = pd.factorize(pdf["o"], use_na_sentinel=False)[0]
        x = np.full((len(names), o.max() + 1), np.nan)
        x[v, o] = pdf["x"].to_numpy(dtype=np.float64)
        row = np.zeros(x.shape)
        row[v, o] = 1
        known = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x, nan=0.0)
        block = np.zeros(len(names), dtype=np.int64)
        block[v] = pdf["blk"].to_numpy()
        if square:
            s = np.stack([(((x - x[i]) ** 2) * known * known[i]).sum(axis=1) for i in range(len(names))])
        else:
            s = x @ x.T
        n, shared = known @ known.T, row @ row.T
        first, last = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        # pairs inside a block belong to its own tile alone
        a, b = np.nonzero(np.triu((shared > 0) & ((first == last) | (block[:, None] != block[None, :]))))
        return pd.DataFrame({"var_a": names[a], "var_b": names[b], "s": s[a, b],
                             "n": n[a, b].astype(np.int64), "shared": shared[a, b].astype(np.int64)})
    return run


def _pair_sums(df: DataFrame, obs: str, var: str, value: str, square: bool) -> DataFrame:
    """(var_a, var_b, s, n, shared) of every pair of variables that share an observation.

    Variables are hashed into blocks and observations into chunks; a row goes once to each tile of
    its block with another. A tile is a bounded matrix, whatever observation is hot; only its pair
    sums leave it. NULL is an observation, or a variable (of strings), like any other; it sorts first.
    """
    d = df.select(F.col(obs).alias("o"), F.coalesce(F.col(var), F.lit(_NULL_VARIABLE)).alias("v"), F.col(value).cast("double").alias("x"))
    count = lambda c, size: d.select(c).distinct().agg(F.ceil(F.count(F.lit(1)) / size)).scalar()
    blocks, chunks = count("v", BLOCK_VARIABLES), count("o", CHUNK_OBSERVATIONS)
    rows = d.select("*", F.pmod(F.xxhash64("v"), blocks).alias("blk"), F.pmod(F.xxhash64("o"), chunks).alias("chunk"))
    tiles = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).select(
        "o", "v", "x", "blk", "chunk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))
    partial = tiles.groupBy("bi", "bj", "chunk").applyInPandas(
        _tile_pairs(square), "var_a string, var_b string, s double, n long, shared long")
    name = lambda c: F.when(F.col(c) != _NULL_VARIABLE, F.col(c)).alias(c)
    return (partial.groupBy("var_a", "var_b").agg(*[F.sum(c).alias(c) for c in ("s", "n", "shared")])
                   .select(name("var_a"), name("var_b"), "s", "n", "shared"))


def pearson_matrix(df: DataFrame, obs: str, var: str, value: str) -> DataFrame:
    """Pearson r of every pair of variables across observations, both orders.

    Variables are centred and scaled to unit length, so that r is the sum of products. A
    zero-variance variable gives NULL, not an error.
    """
    st = df.groupBy(var).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"),
                             F.count(value).alias("n"))
    z = (join_on_keys(df, st, [var])
           .select(obs, var, F.try_divide(F.col(value) - F.col("mu"), F.col("sd") * F.sqrt(F.col("n") - 1)).alias("z")))
    pairs = _pair_sums(z, obs, var, "z", square=False)
    both = lambda a, b: F.struct(F.col(a).alias("var_a"), F.col(b).alias("var_b"))
    orders = F.when(F.col("var_a").eqNullSafe(F.col("var_b")), F.array(both("var_a", "var_b"))).otherwise(
        F.array(both("var_a", "var_b"), both("var_b", "var_a")))
    return pairs.select(F.explode(orders).alias("pair"), F.when(F.col("n") > 0, F.col("s")).alias("corr")).select("pair.*", "corr")


def euclidean_distances(df: DataFrame, obs: str, var: str, value: str) -> DataFrame:
    """Distance between every pair of variables (a < b) over shared observations.

    Observations without a value on either side are left out and the sum is scaled up for them.
    """
    pairs = _pair_sums(df, obs, var, value, square=True).where(~F.col("var_a").eqNullSafe(F.col("var_b")))
    return pairs.select("var_a", "var_b", F.sqrt(F.try_divide(F.col("s") * F.col("shared"), F.col("n"))).alias("distance"))
