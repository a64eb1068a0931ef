"""Fingerprints, links, classes and kept rows against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from setscore.llm import simhash as X
from tests.conftest import SF0001 as SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) per row."""
    prints = [brute_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least: dict = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [(d, f"{p:016x}", least.get(find(p))) for (d, _), p in zip(rows, prints, strict=True)]


def by_text(x):
    return sorted(x, key=str)


ODD = [None, "", " \t\n", "one", "ONE", "two words", "Two words", "É é", "a b c", "A B C", "a b c", "\x0b x \x0c y\r\nz", "w " * 30_000, "İ K ſ x y"]


def test_odd_texts(spark):
    rows = [(i + 5, t) for i, t in enumerate(ODD)] + [(None, "only here x"), (None, "a b c"), (2, "a b c"), (2, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit("x"))
    got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in X.classes(df).collect()]
    assert by_text(got) == by_text(brute_classes(rows))
    kept = X.deduplicate(df)
    assert kept.columns == df.columns
    want = {}
    for (d, t), (_, _, c) in zip(rows, brute_classes(rows), strict=True):
        want.setdefault((c, brute_print(t) if c is None else 0), []).append((d is None, d or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(v) for v in want.values())
    assert X.classes(df.where("false")).collect() == [] and X.deduplicate(df.where("false")).collect() == []


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in X.op9_bit_sliced_simhash(spark, SMALL).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(brute_classes(docs))


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = a.copy()
    for i in range(1000):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    want = [(int(x) ^ int(y)).bit_count() <= radius for x, y in zip(a, b, strict=True)]
    assert X.within_radius(a, b, radius).tolist() == want
    assert not X.within_radius(a, ~a, radius).any()


@pytest.mark.parametrize("split", [2_000, 3])
def test_links_with_hot_keys(spark, monkeypatch, split):
    """A cluster that shares blocks, with and without dealing its key again."""
    monkeypatch.setattr(X, "SPLIT", split)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    prints = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(i, 20)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    prints |= {base ^ (1 << 63), base ^ (1 << 63) ^ (1 << 40)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = {frozenset((r.a, r.b)) for r in X.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert got == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (-5, 100), (7, 7)]
    got = {r.fp: r.root for r in X.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), -5: -5, 100: -5, 101: -5}
