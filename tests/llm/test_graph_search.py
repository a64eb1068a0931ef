"""Graph search against brute force."""

import math

import numpy as np
import pytest

from setscore.llm import graph_search as g

DDL = "vec_id long, embedding array<float>"


def brute(rows, k=g.K):
    ok = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in ok:
        if i % g.EVERY == 0:
            a = np.array(q, dtype=float)
            near = []
            for j, v in ok:
                if j != i and len(v) == len(q):
                    b = np.array(v, dtype=float)
                    near.append((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), j))
            out.setdefault(i, []).append(sorted((round(s, 9), j) for s, j in near)[:k])
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "'x' AS vector", "'x' AS shard", "1 AS dim", "'x' AS ids", "2 AS label")
    index, shards = g.build_index(df)
    got = g.search(index, shards, g.vectors_of(df, "vec_id", "embedding").where(f"vec_id % {g.EVERY} = 0")).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], round(-r.score, 9), r.vec_id))
    return out


def recall(got, want):
    hits = sum(len({j for _, _, j in got.get(q, [])} & {j for _, j in lists[0]}) for q, lists in want.items())
    return hits / sum(len(lists[0]) for lists in want.values())


def test_recall_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "SHARD_ROWS", 700)
    monkeypatch.setattr(g, "QUERY_ROWS", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.4 * rng.normal(size=24)).astype(np.float32)]) for i in range(3000)]
    got, want = found(spark, rows), brute(rows)
    assert set(got) == set(want) and all([r for r, _, _ in x] == [1, 2, 3, 4, 5] for x in got.values())
    assert recall(got, want) >= 0.97
    exact = {(q, j): s for q, lists in want.items() for s, j in lists[0]}
    assert all(exact.get((q, j), s) == s for q, x in got.items() for _, s, j in x)


def test_copies_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(1000)] + [(2000, [0.0, 1.0]), (2001, [0.0, -1.0]), (2050, [0.25, 0.25])]
    got, want = found(spark, rows), brute(rows)
    assert {q: [(s, j) for _, s, j in x] for q, x in got.items()} == {q: x[0] for q, x in want.items()}
    few = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])]
    got = found(spark, few)
    assert {q: [j for _, _, j in x] for q, x in got.items()} == {0: [7, 50], 50: [7, 0]}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [-0.0, 1.0]), (8, [0.0, 1.0]),
            (9, [1.0, 2.0, 3.0]), (50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0]), (0, [1.0, 0.0]), (150, [1e-30, 1e-30]), (200, [5.0])]
    got, want = found(spark, rows), brute(rows)
    assert {q: [(s, j) for _, s, j in x] for q, x in got.items()} == {q: x[0] for q, x in want.items() if x[0]}
    assert found(spark, []) == {}


def test_a_vec_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = found(spark, rows)
    assert sorted((r, j) for r, _, j in got[0]) == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 2, 5, 65, 130])
def test_small_graphs_reach_all(n):
    points = g.unit(np.random.default_rng(n).normal(size=(n, 3)))
    graph, entries = g.build_graph(points)
    ids, _ = g.beam_search(graph, points, entries, points[:1], max(n, 1))
    assert sorted(i for i in ids[0] if i >= 0) == list(range(n))


def test_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in g.op11_robust_graph(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want) and recall(got, want) >= 0.98
