"""Gene-set scoring (G1-G7) against an independent brute force, plus properties."""

import numpy as np
import pytest

from setscore.functions.stats import phi_np, phi_py
from setscore.operators import scoring as S
from setscore.operators.pseudobulk import complete_matrix
from setscore.operators.scoring import kernel_cdf, rank_genes, rank_sparse, score_gene_sets, score_sparse, walk_scores


def _brute(X, genes, units, sets):
    """Full GSVA walk over every position (no hits-only shortcut)."""
    sd = X.std(axis=1, ddof=1)
    keep = sd > 0
    X, genes, h = X[keep], [g for g, k in zip(genes, keep) if k], sd[keep] / 4
    p, n = X.shape
    phiv = np.vectorize(phi_py)
    Z = np.array([phiv((X[i][:, None] - X[i][None, :]) / h[i]).mean(axis=1) for i in range(p)])
    out = {}
    for j, u in enumerate(units):
        order = sorted(range(p), key=lambda i: (-round(Z[i, j], 9), genes[i]))
        r = np.zeros(p)
        for pos, i in enumerate(order, start=1):
            r[i] = abs(p - pos + 1 - p / 2)
        for s, gl in sets.items():
            idx = {genes.index(g) for g in gl if g in genes}
            if not idx:
                continue
            m, tot = len(idx), sum(r[i] for i in idx)
            cum = hi = lo = 0.0
            for i in order:
                cum += r[i] / tot if i in idx else -1.0 / (p - m)
                hi, lo = max(hi, cum), min(lo, cum)
            out[(u, s)] = hi + lo
    return out


def _long(spark, X, genes, units):
    rows = [(u, g, float(X[i, j])) for i, g in enumerate(genes) for j, u in enumerate(units)]
    return spark.createDataFrame(rows, "unit string, gene string, value double")


def _sets_df(spark, sets):
    return spark.createDataFrame([(s, g) for s, gl in sets.items() for g in gl], "set_name string, gene string")


@pytest.mark.parametrize("seed,p,n", [(1, 12, 9), (2, 20, 31)])
def test_matches_brute_force(spark, seed, p, n):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(p, n)) * rng.uniform(0.5, 3, size=(p, 1))
    X[3] = 1.5                                              # a constant gene is dropped (G1)
    genes, units = [f"g{i:02d}" for i in range(p)], [f"u{j}" for j in range(n)]
    sets = {"a": genes[:5], "b": genes[4:9] + ["missing"], "c": ["missing"]}
    got = {(r["unit"], r["set_name"]): r["score"]
           for r in score_gene_sets(_long(spark, X, genes, units), _sets_df(spark, sets)).collect()}
    want = _brute(X, genes, units, sets)
    assert set(got) == set(want)                            # set "c" has no gene: no rows
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert all(-1 <= v <= 1 for v in got.values())


def test_walk_golden(spark):
    # p = 4 genes ranked g1 > g2 > g3 > g4; hits {1,2}: 1, {3,4}: -1, {1,4}: 1/3
    ranked = rank_genes(spark.createDataFrame([("u", f"g{i}", 1.0 - i / 10) for i in range(1, 5)],
                                              "unit string, gene string, z double"))
    sets = spark.createDataFrame([("top", "g1"), ("top", "g2"), ("bottom", "g3"), ("bottom", "g4"),
                                  ("ends", "g1"), ("ends", "g4")], "set_name string, gene string")
    got = {r["set_name"]: r["score"] for r in walk_scores(ranked, sets).collect()}
    assert got["top"] == pytest.approx(1.0)
    assert got["bottom"] == pytest.approx(-1.0)
    assert got["ends"] == pytest.approx(1 / 3)


def test_all_genes_in_set_no_penalty(spark):
    ranked = rank_genes(spark.createDataFrame([("u", "a", 0.9), ("u", "b", 0.1)], "unit string, gene string, z double"))
    sets = spark.createDataFrame([("s", "a"), ("s", "b")], "set_name string, gene string")
    assert walk_scores(ranked, sets).collect()[0]["score"] == pytest.approx(1.0)


def test_invariant_under_affine_map_and_partitions(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(10, 15))
    genes, units = [f"g{i}" for i in range(10)], [f"u{j}" for j in range(15)]
    sets = {"a": genes[:4]}
    base = {(r["unit"]): r["score"] for r in score_gene_sets(_long(spark, X, genes, units), _sets_df(spark, sets)).collect()}
    X2 = X.copy()
    X2[2] = 3.0 * X2[2] + 7.0                                # strictly increasing map of one gene
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        moved = {(r["unit"]): r["score"]
                 for r in score_gene_sets(_long(spark, X2, genes, units), _sets_df(spark, sets)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base.keys() == moved.keys()
    assert max(abs(base[k] - moved[k]) for k in base) < 1e-9


def _direct(x, h):
    return np.array([np.mean([phi_py((a - b) / h) for b in x]) for a in x])


@pytest.mark.parametrize("shape", ["normal", "outlier", "ties", "heavy", "tiny"])
def test_kernel_cdf_equals_direct_sum(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)
    if shape == "outlier":
        x[7] = 1e6                                           # cells far apart
    if shape == "ties":
        x = np.repeat([0.0, -0.0, 1.0, 2.0], 15)
    if shape == "heavy":
        x = np.exp(4 * x)
    if shape == "tiny":
        x = 1e3 + 1e-6 * x
    df = _long(spark, np.stack([x, rng.normal(size=60)]), ["a", "b"], [f"u{j}" for j in range(60)])
    got = {(r["gene"], r["unit"]): r["z"] for r in kernel_cdf(df).collect()}
    want = _direct(x, x.std(ddof=1) / 4)
    tolerance = 1e-9 if shape == "tiny" else 2e-13           # there the values themselves have seven digits
    assert len(got) == 120 and max(abs(got[("a", f"u{j}")] - want[j]) for j in range(60)) < tolerance


def test_expansions_of_many_values():
    """Moments and translations alone: 5,000 values, error far below the ninth digit."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=4000), rng.normal(size=1000) * 4 + 3])
    h = x.std(ddof=1) / 4
    scaled = (x - x.min()) / h
    cell = np.floor(scaled / S.CELL)
    u = scaled - (cell + 0.5) * S.CELL
    cells, at = np.unique(cell, return_inverse=True)
    moments = np.stack([np.bincount(at, weights=u ** i) for i in range(S.ORDER + 1)], axis=1)
    c = S._translate(cells.astype(np.int64), moments, S.translations())
    z = (c[at] * u[:, None] ** np.arange(S.ORDER + 1)).sum(axis=1) / len(x)
    some = rng.integers(0, len(x), 40)
    want = np.array([phi_np((x[j] - x) / h).mean() for j in some])
    assert np.abs(z[some] - want).max() < 1e-14


def test_values_that_are_no_numbers_take_no_part(spark):
    rows = [("u1", "a", 1.0), ("u2", "a", 2.0), ("u3", "a", float("nan")), ("u4", "a", None), ("u5", "a", float("inf")), ("u6", "a", 4.0), ("u1", "b", 3.0)]
    got = {r["unit"]: r["z"] for r in kernel_cdf(spark.createDataFrame(rows, "unit string, gene string, value double")).collect()}
    x = np.array([1.0, 2.0, 4.0])
    assert got == pytest.approx(dict(zip(["u1", "u2", "u6"], _direct(x, x.std(ddof=1) / 4), strict=True)))


# ---- sparse input -----------------------------------------------------------------------------

def _both(spark, rows, sets):
    """Scores of the sparse rows, and of their matrix completed with zeros."""
    df = spark.createDataFrame(rows, "unit string, gene string, value double")
    full = complete_matrix(df.withColumnRenamed("value", "mean_exp"))
    key = lambda d: {(r["unit"], r["set_name"]): r["score"] for r in d.collect()}
    return key(score_sparse(df, _sets_df(spark, sets))), key(score_gene_sets(full, _sets_df(spark, sets)))


@pytest.mark.parametrize("seed,density,negative", [(1, 0.1, False), (2, 0.5, True), (3, 0.9, False)])
def test_sparse_equals_completed_matrix(spark, seed, density, negative):
    rng = np.random.default_rng(seed)
    genes = [f"g{i:02d}" for i in range(30)]
    rows = [(f"u{j}", g, float(rng.integers(-3 if negative else 1, 4) + (0 if i % 2 else rng.normal())))
            for j in range(25) for i, g in enumerate(genes) if rng.random() < density or i == 7 and j != 3 or i == 8]
    rows += [(f"u{j}", "same", 2.0) for j in range(25)]                # constant: dropped
    sets = {"a": genes[:6], "b": [*genes[4:12], "missing"], "all": genes, "one": [genes[8]], "none": ["missing", "same"]}
    sparse, full = _both(spark, rows, sets)
    assert set(sparse) == set(full) and len(sparse) == 100
    assert max(abs(sparse[k] - full[k]) for k in full) < 1e-12


def test_sparse_rows_without_numbers(spark):
    """NULL is absent; NaN leaves its gene out of its unit; a unit of NULLs only has all zeros."""
    nan = float("nan")
    rows = [("u1", "a", 1.0), ("u1", "b", 2.0), ("u2", "a", nan), ("u2", "c", 3.0), ("u3", "b", None), ("u4", "c", 1.0), ("u4", "d", 0.0), ("u1", "d", 5.0), ("u2", "e", 1.0)]
    sparse, full = _both(spark, rows, {"s": ["a", "c"], "t": ["b", "d", "e"]})
    assert sparse == pytest.approx(full, abs=1e-12) and len(full) == 8


def test_sparse_reads_no_completed_matrix(spark):
    """The rows that are ranked: those given, twice, and those of the asked genes."""
    rows = [(f"u{j}", f"g{(j * 7 + k) % 200}", 1.0 + k) for j in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "unit string, gene string, value double")
    ranked = rank_sparse(df, spark.createDataFrame([("g0",), ("g7",)], "gene string"))
    assert ranked.count() <= len(rows) + 2 * 40 and score_sparse(df.where("false"), _sets_df(spark, {"s": ["g0"]})).collect() == []
