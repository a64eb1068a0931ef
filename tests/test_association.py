"""Statistics behind the plots: golden cases T2-T6, W3 and the t tail."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscore.functions.stats import phi, phi_np, phi_py
from setscore.operators import association as A
from setscore.operators import summaries as S


def test_spearman_golden(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0)], "x double, y double")
    row = A.spearman(df, [], "x", "y").collect()[0]
    assert row["n"] == 4 and row["r"] == pytest.approx(0.948683, abs=1e-6)


def _t_two_sided_numeric(t, df):
    # Simpson integration of the Student density from 0 to |t|
    c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
    n, a, b = 20000, 0.0, abs(t)
    h = (b - a) / n
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    s = f(a) + f(b) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, n))
    return 1 - 2 * s * h / 3


@pytest.mark.parametrize("df_", [1, 2, 3, 4, 7, 10, 31, 60])
def test_t_tail_and_quantile(spark, df_):
    t = 1.7
    got = spark.range(1).select(A.t_two_sided_p(F.lit(t), F.lit(df_)).alias("p")).collect()[0]["p"]
    assert got == pytest.approx(_t_two_sided_numeric(t, df_), abs=1e-9)
    assert spark.range(1).select(A.t_quantile(0.975, F.lit(df_))).first()[0] == pytest.approx(
        {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 7: 2.3646, 10: 2.2281, 31: 2.0395, 60: 2.0003}[df_], abs=1e-4)


def test_t_tail_of_ten_million_degrees(spark):
    """The normal tail plus its first correction; the work doesn't grow with the degrees of freedom."""
    t, nu = 1.7, 10 ** 7
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    want = math.erfc(t / math.sqrt(2)) + 2 * density * (t ** 3 + t) / (4 * nu)
    row = spark.range(1).select(A.t_two_sided_p(F.lit(t), F.lit(nu)).alias("p"), A.t_quantile(0.975, F.lit(nu)).alias("q"),
                                A.t_two_sided_p(F.lit(t), F.lit(0)).alias("none"), A.t_quantile(0.975, F.lit(0)).alias("none_q"),
                                A.t_two_sided_p(F.lit(float("inf")), F.lit(5)).alias("far")).first()
    assert row.p == pytest.approx(want, abs=1e-13) and row.q == pytest.approx(1.959964 + 2.4e-7, abs=1e-6)
    assert row.none is None and row.none_q is None and row.far == 0.0


def test_wilcoxon_golden(spark):
    rows = [("f", "x", v) for v in (1.0, 2.0, 3.0)] + [("f", "y", v) for v in (4.0, 5.0)]
    df = spark.createDataFrame(rows, "facet string, grp string, v double")
    st = A.wilcoxon(df, ["facet"], "grp", "v", ("x", "y"))
    row = A.wilcoxon_p(st, ["facet"]).collect()[0]
    assert row["w"] == 0.0
    assert row["p"] == pytest.approx(0.2) and row["p_method"] == "exact"
    assert row["p_normal"] == pytest.approx(0.1489, abs=1e-4)


def test_wilcoxon_methods(spark):
    """Ties and large groups take the normal p, a facet without a second group has none, and normal is as asked."""
    rows = ([("ties", "x", 1.0), ("ties", "x", 2.0), ("ties", "y", 2.0)] + [("lone", "x", 1.0)] + [(None, "x", 1.0), (None, "y", 2.0)]
            + [("big", "x" if k % 3 else "y", float(k)) for k in range(90)])
    st = A.wilcoxon(spark.createDataFrame(rows, "facet string, grp string, v double"), ["facet"], "grp", "v", ("x", "y"))
    got = {r.facet: r for r in A.wilcoxon_p(st, ["facet"]).collect()}
    assert {k: r.p_method for k, r in got.items()} == {"ties": "normal", "lone": None, None: "exact", "big": "normal"}
    assert got["lone"].p is None and got[None].p == 1.0 and got["big"].p == got["big"].p_normal
    assert {r.p_method for r in A.wilcoxon_p(st, ["facet"], "normal").collect()} == {"normal", None}
    with pytest.raises(ValueError):
        A.wilcoxon_p(st, ["facet"], "other")


def test_wilcoxon_exact_counts():
    counts = A._pwilcox_counts(3, 2)
    assert counts.sum() == math.comb(5, 3)
    assert list(counts) == [1, 1, 2, 2, 2, 1, 1]


def test_box_golden(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 4.0, 9.0)], "g string, v double")
    row = S.box_stats(df, ["g"], "v").collect()[0]
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 3.0, 5.25)
    assert (row["lower"], row["upper"], row["n_outliers"]) == (1.0, 9.0, 0)


def test_box_keeps_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "g string, v double")
    got = {r["g"]: r["n"] for r in S.box_stats(df, ["g"], "v").collect()}
    assert got == {None: 2, "a": 1}


def test_pearson_constant_is_null_not_error(spark):
    rows = [(o, "a", float(o)) for o in range(4)] + [(o, "b", 5.0) for o in range(4)] + \
           [(o, "c", float(o * o)) for o in range(4)]
    df = spark.createDataFrame(rows, "o long, v string, x double")
    got = {(r["var_a"], r["var_b"]): r["corr"] for r in A.pearson_matrix(df, "o", "v", "x").collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "c")] == pytest.approx(got[("c", "a")])


def test_pair_statistics_over_many_tiles(spark, monkeypatch):
    """Against NumPy, with blocks and chunks so small that every tile is partial; NULLs and gaps included."""
    import numpy as np
    monkeypatch.setattr(A, "BLOCK_VARIABLES", 3)
    monkeypatch.setattr(A, "CHUNK_OBSERVATIONS", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 13))
    rows = [(None if o == 0 else f"o{o}", None if v == 0 else f"v{v:02d}", float(x[v, o])) for v in range(10) for o in range(13)]
    name = lambda v: None if v == 0 else f"v{v:02d}"
    df = spark.createDataFrame(rows, "o string, v string, x double")
    corr = {(r.var_a, r.var_b): r["corr"] for r in A.pearson_matrix(df, "o", "v", "x").collect()}
    want = np.corrcoef(x)
    assert len(corr) == 100 and all(abs(corr[name(a), name(b)] - want[a, b]) < 1e-12 for a in range(10) for b in range(10))
    far = A.euclidean_distances(df, "o", "v", "x").collect()
    assert len(far) == 45
    for r in far:
        a, b = (0 if k is None else int(k[1:]) for k in (r.var_a, r.var_b))
        assert a < b and abs(r.distance - np.linalg.norm(x[a] - x[b])) < 1e-12
    gaps = spark.createDataFrame([("p", "a", 0.0), ("q", "a", None), ("p", "b", 3.0), ("q", "b", 1.0), ("p", "c", None), ("q", "d", 1.0)],
                                 "o string, v string, x double")
    got = {(r.var_a, r.var_b): r.distance for r in A.euclidean_distances(gaps, "o", "v", "x").collect()}
    assert got == {("a", "b"): pytest.approx(3 * 2 ** 0.5), ("a", "c"): None, ("a", "d"): None, ("b", "c"): None, ("b", "d"): 0.0}
    assert A.pearson_matrix(df.limit(0), "o", "v", "x").count() == 0


def test_ranking_sorts_before_rounding(spark):
    # W3 golden: 0.1234 and 0.1231 both print 0.123, in that order
    df = spark.createDataFrame([("u2", 0.1231, 0.0), ("u1", 0.1234, 0.0)], "unit string, s1 double, s2 double")
    rows = S.ranking(df, ["s1", "s2"]).collect()
    assert [r["unit"] for r in rows] == ["u1", "u2"] and [r["s1"] for r in rows] == [0.123, 0.123]


def test_density_matches_direct_sum(spark):
    import numpy as np
    vals = [0.1, 0.15, 0.3, 0.32, 0.5, 0.9]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    d = sorted((r["i"], r["x"], r["density"], r["scaled"]) for r in S.violin_density(df, ["g"], "v").collect())
    assert len(d) == 512 and d[0][1] == pytest.approx(0.1) and d[-1][1] == pytest.approx(0.9)
    n = len(vals)
    q1, q3 = np.percentile(vals, [25, 75])            # type 7, as R's quantile default
    bw = 0.9 * min(np.std(vals, ddof=1), (q3 - q1) / 1.34) * n ** -0.2
    for i in (0, 200, 511):
        xi = d[i][1]
        expect = sum(math.exp(-0.5 * ((xi - v) / bw) ** 2) for v in vals) / (n * bw * math.sqrt(2 * math.pi))
        assert d[i][2] == pytest.approx(expect, rel=1e-12)
    assert max(r[3] for r in d) == pytest.approx(1.0)


def test_density_of_null_keys_and_values(spark):
    rows = [(None, "a", 1.0), (None, "a", 2.0), ("a", None, 1.0), ("a", None, 3.0), ("a", None, None), ("b", "b", 1.0)]
    d = S.violin_density(spark.createDataFrame(rows, "g string, h string, v double"), ["g", "h"], "v", 16)
    got = {(r.g, r.h): r.top for r in d.groupBy("g", "h").agg(F.max("x").alias("top")).collect()}
    assert got == {(None, "a"): pytest.approx(2.0), ("a", None): pytest.approx(3.0)}


def test_phi_accuracy(spark):
    """Double precision in all three forms, against erfc."""
    grid = [k / 16 for k in range(-640, 641)]
    want = [0.5 * math.erfc(-u / math.sqrt(2)) for u in grid]
    rows = spark.createDataFrame([(u,) for u in grid], "u double").select("u", phi(F.col("u")).alias("p")).collect()
    columns = {r.u: r.p for r in rows}
    for u, w, a in zip(grid, want, phi_np(np.array(grid)), strict=True):
        assert abs(phi_py(u) - w) < 1e-15 and abs(a - w) < 1e-15 and abs(columns[u] - w) < 1e-15
        assert w < 1e-300 or u > 0 or phi_py(u) == pytest.approx(w, rel=2e-8)
    assert phi_py(-float("inf")) == 0.0 and phi_py(float("inf")) == 1.0


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_odd_values_rank_alike_with_and_without_exchange_reuse(spark, reuse):
    """NaN is above all, NULL has no rank, zeros of either sign tie, and a hot value is one tie."""
    from setscore.operators import ranks
    nan = float("nan")
    rows = [("a", v) for v in (nan, 1.0, 1.0, -0.0, 0.0, None)] + [("b", 5.0)] * 400 + [("b", 1.0), ("b", nan)] + [("c", None)]
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.createDataFrame(rows, "f string, v double").repartition(7)
        got = {(r.f, str(r.v).replace("-0.0", "0.0")): r.r for r in ranks.mid_rank(df, ["f"], "v", "r").collect()}
        q = {r.f: (r.n, r.lo, r.hi) for r in ranks.quantiles(df, ["f"], "v", (0.0, 0.5), ("lo", "hi")).collect()}
        big = spark.range(30_003).selectExpr("id % 3 AS f", "pmod(xxhash64(id), 5000) / 7.0 AS v")
        wrong = (ranks.mid_rank(big, ["f"], "v", "r")
                 .selectExpr("r", "rank() OVER (PARTITION BY f ORDER BY v) + (count(*) OVER (PARTITION BY f, v) - 1) / 2 AS w").where("r <> w").count())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {("a", "nan"): 5.0, ("a", "1.0"): 3.5, ("a", "0.0"): 1.5, ("a", "None"): None,
                   ("b", "5.0"): 201.5, ("b", "1.0"): 1.0, ("b", "nan"): 402.0, ("c", "None"): None}
    assert q == {"a": (5, 0.0, 1.0), "b": (402, 1.0, 5.0)} and wrong == 0


def test_ranks_and_quantiles(spark):
    """Against pandas ranks and NumPy quantiles."""
    import numpy as np
    import pandas as pd
    from setscore.operators import ranks
    rng = np.random.default_rng(11)
    rows = [(f, float(v)) for f, n in (("a", 300), ("b", 25), (None, 17), ("c", 1))
            for v in rng.integers(0, 20, n)] + [("a", None)] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")   # runs span Arrow batches
    try:
        df = spark.createDataFrame(rows, "f string, v double")
        got = ranks.mid_rank(df, ["f"], "v", "r").toPandas()
        q = ranks.quantiles(df, ["f"], "v", (0.25, 0.5, 0.75), ("q1", "median", "q3")).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf = pd.DataFrame(rows, columns=["f", "v"]).assign(fk=lambda d: d.f.fillna("~"))
    pdf["r"] = pdf.groupby("fk")["v"].rank(method="average")
    got = got.assign(fk=got.f.fillna("~"))
    merged = got.merge(pdf.drop_duplicates(["fk", "v"]), on=["fk", "v"], suffixes=("", "_x"))
    assert len(got) == len(rows) and np.allclose(merged.r, merged.r_x, equal_nan=True)
    assert got[got.v.isna()].r.isna().all()
    for _, r in q.iterrows():
        vals = pdf[pdf.fk == (r.f if r.f is not None else "~")].v.dropna()
        assert np.allclose([r.q1, r["median"], r.q3], np.percentile(vals, [25, 50, 75]))


# ---- p of Spearman ----------------------------------------------------------------------------

def _spearman_p(spark, x, y):
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    row = A.spearman(spark.createDataFrame(rows, "x double, y double"), [], "x", "y").first()
    return row["p"], row["p_method"]


def test_spearman_counts_are_the_permutations():
    from itertools import permutations
    assert A.spearman_counts(3) == [1, 2, 0, 2, 1]           # S = 0, 2, 2, 6, 6, 8 over six orders
    for n in (4, 6):
        got = A.spearman_counts(n)
        want = [0] * len(got)
        for p in permutations(range(n)):
            want[sum((i - v) ** 2 for i, v in enumerate(p)) // 2] += 1
        assert got == want
    assert sum(A.spearman_counts(9)) == math.factorial(9)


def test_spearman_exact_golden(spark):
    # nine pairs of hue and panel score, S = 48: rho 0.6, p 0.0968 as published with the data
    x = [44.4, 45.9, 41.9, 53.3, 44.7, 44.1, 50.7, 45.2, 60.1]
    y = [2.6, 3.1, 2.5, 5.0, 3.6, 4.0, 5.2, 2.8, 3.8]
    p, method = _spearman_p(spark, x, y)
    assert method == "exact" and p == pytest.approx(0.0968, abs=5e-5)
    # n = 4, S = 2: the identity and three neighbours swapped, so 2 * 4 / 24
    assert _spearman_p(spark, [1, 2, 3, 4], [1, 2, 4, 3]) == (pytest.approx(8 / 24), "exact")
    assert _spearman_p(spark, [1, 2, 3, 4], [4, 3, 2, 1]) == (pytest.approx(2 / 24), "exact")
    assert _spearman_p(spark, [1, 2], [5, 6]) == (1.0, "exact")


@pytest.mark.parametrize("n", [10, 12])
def test_spearman_series_is_near_the_exact_tail(spark, n):
    counts = np.cumsum(A.spearman_counts(n)) / math.factorial(n)
    rng = np.random.default_rng(n)
    for tilt in (0.0, 0.5, 1.5, -0.7):
        y = rng.permutation(n) + tilt * np.arange(n)
        ranks = np.argsort(np.argsort(y))
        s = int(((ranks - np.arange(n)) ** 2).sum())
        low = min(s, n * (n * n - 1) // 3 - s)
        p, method = _spearman_p(spark, range(n), ranks)
        assert method == "edgeworth" and p == pytest.approx(min(1.0, 2 * counts[low // 2]), abs=2e-3)


def test_spearman_method_by_size_and_ties(spark):
    t = _t_two_sided_numeric
    x, y = [1, 2, 2, 4, 5, 6], [1, 3, 2, 4, 6, 5]
    p, method = _spearman_p(spark, x, y)
    r = np.corrcoef([1, 2.5, 2.5, 4, 5, 6], y)[0, 1]
    assert method == "t" and p == pytest.approx(t(r * math.sqrt(4 / (1 - r * r)), 4), abs=1e-9)
    rng = np.random.default_rng(1)
    for n, method in ((1289, "edgeworth"), (1290, "t")):
        y = rng.permutation(n)
        p, got = _spearman_p(spark, range(n), y)
        r = np.corrcoef(np.arange(n), y)[0, 1]
        assert got == method and p == pytest.approx(math.erfc(abs(r) * math.sqrt(n - 1) / math.sqrt(2)), abs=2e-3)
    assert _spearman_p(spark, [1, 1, 1], [1, 2, 3]) == (None, None) and _spearman_p(spark, [1], [1]) == (None, None)


def test_violin_density_from_moments(spark):
    """Close and far values, a hot one and a group of equal ones: the same as the sum over all values."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), "b": np.append(np.full(5000, 1.5), rng.exponential(size=500)), "c": np.full(4, 2.0),
              "d": np.append(rng.normal(size=200), [1e6, -1e6])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v]
    got = S.violin_density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 64).toPandas()
    for g, v in groups.items():
        own = got[got.g == g].sort_values("i")
        q1, q3 = np.quantile(v, [0.25, 0.75])
        sd = v.std(ddof=1)
        low = min(sd, (q3 - q1) / 1.34) or sd or abs(v.min()) or 1.0
        bw = 0.9 * low * len(v) ** -0.2
        want = np.exp(-0.5 * (np.subtract.outer(own.x.to_numpy(), v) / bw) ** 2).sum(axis=1) / (len(v) * bw * np.sqrt(2 * np.pi))
        assert np.abs(own.density.to_numpy() - want).max() <= 1e-11 * want.max(), g


def test_exact_rank_sum_of_many_facets(spark, monkeypatch):
    """Facets of few pairs of sizes: p equals enumeration, and needs no exchange after the statistic."""
    import itertools
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for f in range(12):
        n1, n2 = (3, 4) if f % 2 else (5, 3)
        v = rng.permutation(n1 + n2).astype(float)
        rows += [(f, "x" if k < n1 else "y", float(x)) for k, x in enumerate(v)]
        w = sum(v[:n1] + 1) - n1 * (n1 + 1) / 2
        every = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        tail = sum(e >= w for e in every) if w > n1 * n2 / 2 else sum(e <= w for e in every)
        want[f] = min(1.0, 2 * tail / len(every))
    df = spark.createDataFrame(rows, "f long, g string, v double")
    got = A.wilcoxon_p(A.wilcoxon(df, ["f"], "g", "v", ("x", "y")), ["f"]).collect()
    assert {r["p_method"] for r in got} == {"exact"}
    assert {r["f"]: pytest.approx(r["p"]) for r in got} == want
