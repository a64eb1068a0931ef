"""Suffix-array search against direct search."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from setscore.llm import contamination as X
from setscore.llm.common import WordHasher, alnum_bytes
from tests.llm.conftest import ROWS

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(text: str | None, items: list[tuple[str, str]]) -> tuple[int, set[int], set[str], int]:
    w = words(text)
    hit, who, longest = set(), set(), 0
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        for o in range(len(v) - k + 1 if v else 0):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == v[o:o + k]:
                    hit.update(range(p, p + k))
                    who.add(item)
                    n = k
                    while p + n < len(w) and o + n < len(v) and w[p + n] == v[o + n]:
                        n += 1
                    longest = max(longest, n)
    return len(w), hit, who, longest


def case(seed: int):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dd", "É", "9", "x-y"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([0, 1, 2, 5, 10, 12, 40]))) for k in range(6)] + [("i0", "dd dd"), ("z", "")]
    items.append(("copy", items[4][1]))
    docs = [say(rng.choice([0, 3, 30, 200])) + " " + rng.choice(items)[1] + ", " + say(5) for _ in range(12)]
    return items, docs


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("shard_words", [1_000_000, 60, 7])
def test_search_against_brute_force(seed, shard_words):
    items, docs = case(seed)
    got = X.search_batch([d.encode() for d in docs], X.test_set(items, 10), shard_words)
    for d, r in zip(docs, got, strict=True):
        n, hit, who, longest = brute(d, items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), sorted(who))
        assert {p for s in r["spans"] for p in range(s["start"], s["end"])} == hit
        assert max([m["length"] for m in r["matches"]], default=0) == longest


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(1, 4, 500), np.zeros(65, np.int64)])
    order = X.suffix_array(ids, np.arange(500), 64).tolist()
    assert order == sorted(range(500), key=lambda p: ids[p:p + 64].tolist())


def test_word_hashes_follow_words():
    text = "One  two,ONE é\n9x the-end"
    h, s, e = WordHasher(alnum_bytes()).words(text.encode())
    assert [text.encode()[a:b].decode().translate(LOW) for a, b in zip(s, e, strict=True)] == words(text)
    assert h[0] == h[2] and len(set(h.tolist())) == len(set(words(text)))


def test_odd_rows_and_blocks(spark, odd):
    items = [("b", "quick brown fox jumps over the lazy dog The quick brown"), ("a", "one"), (None, "no id"), ("e", None), ("b", "same text of two rows here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    known = [(i or "", t) for i, t in items if t]
    for block_bytes in (1 << 20, 20):
        out = X.longest_matches(odd, bench, block_bytes=block_bytes)
        name = out.columns[-1]
        assert out.columns[:-1] == odd.columns and name not in odd.columns
        got = sorted((str(r.doc_id), r[name].n_words, r[name].n_hit, r[name]["items"]) for r in out.select("doc_id", F.col(name)).collect())
        want = []
        for r in ROWS:
            n, hit, who, _ = brute(r[1], known) if (r[1] or "")[:9] != "The quick" else (72_000, set(range(1, 71_994)), {"b"}, 0)
            want.append((str(r[0]), n, len(hit), sorted(who)))
        if block_bytes > 20:
            assert got == sorted(want)
        else:
            assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    clean = X.decontaminate(odd, bench)
    assert clean.columns == odd.columns
    assert X.decontaminate(odd, bench.where("false")).count() == len(ROWS)
    assert X.decontaminate(odd.where("false"), bench).collect() == []


def test_equal_windows_and_places_cost_no_product():
    """A repeated word in text and item, and a beginning that 3,000 items share: each place is matched once."""
    start = time.monotonic()
    r = X.search_batch([b"w " * 100_000], X.test_set([("a", "w " * 2_000)], 10), 1_000_000)[0]
    assert (r["n_hit"], r["items"], len(r["matches"])) == (100_000, ["a"], 98_001) and time.monotonic() - start < 20
    same = " ".join(f"p{i}" for i in range(50))
    tests = X.test_set([(f"i{k}", f"{same} x{k} y z") for k in range(3_000)], 10)
    for r in X.search_batch([f"z {same} x77 y k".encode()] * 20, tests, 1_000_000):
        assert (r["n_hit"], len(r["items"])) == (52, 3_000)
        assert r["matches"] == [{"item": "i77", "item_start": 0, "start": 1, "length": 52}]


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_the_longest_of_their_places(seed):
    items, docs = case(seed + 100)
    known = {i: words(t) for i, t in items[:6]} | {"copy": words(items[4][1])}
    for d, r in zip(docs, X.search_batch([d.encode() for d in docs], X.test_set([*known_text(known)], 10), 60), strict=True):
        w = words(d)
        best = {}
        for v in known.values():
            k = min(10, len(v))
            for o in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == v[o:o + k]:
                        n = k
                        while p + n < len(w) and o + n < len(v) and w[p + n] == v[o + n]:
                            n += 1
                        best[p] = max(best.get(p, 0), n)
        want = {(p, n) for p, n in best.items() if best.get(p - 1, 0) <= n}
        assert {(m["start"], m["length"]) for m in r["matches"]} == want
        for m in r["matches"]:
            assert known[m["item"]][m["item_start"]:m["item_start"] + m["length"]] == w[m["start"]:m["start"] + m["length"]]


def known_text(known: dict) -> list[tuple[str, str]]:
    return [(i, " ".join(v)) for i, v in known.items()]
