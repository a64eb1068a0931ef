"""Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from setscore.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k:k + 3])) for k in range(0, len(now), 3)])
    return levels


def path(levels, k):
    out = []
    for now in levels[:-1]:
        f = k // 3 * 3
        out.append(("".join(now[f:k]), "".join(now[k + 1:f + 3])))
        k //= 3
    return out


def brute(rows):
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        a = leaf_of(doc_id, source, lang, n_chars, text)
        b = leaf_of(doc_id, source, lang, n_chars, text.replace("\n", "")) if changed else a
        by.setdefault(source, []).append(((doc_id is not None, doc_id or 0), a, b, doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([r[1] for r in sorted(by[s])]) for s in sources}
    upper = tree([lower[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for k, (_, a, b, doc_id) in enumerate(sorted(by[s])):
            steps = path(lower[s], k) + path(upper, i)
            back = b
            for left, right in steps:
                back = sha(left + back + right)
            root = upper[-1][0]
            out.append((doc_id, a, lower[s][-1][0], root, sha("".join(x + y for x, y in steps)), back, back == root))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    monkeypatch.setattr(merkle, "RUN", 2)
    monkeypatch.setattr(merkle, "ROWS", 4)


def test_many_levels_and_sources(spark, small):
    rnd = random.Random(3)
    ids = [rnd.choice([rnd.randint(0, 400), rnd.randint(-(1 << 63), (1 << 63) - 1)]) for _ in range(400)]
    rows = [(i, rnd.choice(["a\nb", "ü\n", "x", None, ""]), rnd.choice(["en", None]), rnd.choice([None, "", "hot", "hot", "hot", "é", *map(str, range(30))]), 1) for i in ids]
    got = found(merkle.manifest(spark.createDataFrame(rows, DDL).repartition(4)))
    assert got == brute(rows) and not all(r[-1] for r in got)


def test_a_hot_doc_id_with_copies_and_other_texts(spark, small):
    rows = [(7, f"text\n{k % 50}", "en", "hot", 1) for k in range(150)] + [(k, "t", "en", "hot", 1) for k in range(0, 20)] + [(None, "n\n", "en", "hot", 1)] * 5
    assert found(merkle.manifest(spark.createDataFrame(rows, DDL))) == brute(rows)


def test_edges_of_words_and_one_leaf(spark):
    rows = [(i, "t\n", "en", "s", i) for i in (-(1 << 63), -65, -64, -1, 0, 63, 64, (1 << 22) - 1, 1 << 22, (1 << 63) - 1)]
    assert found(merkle.manifest(spark.createDataFrame(rows, DDL))) == brute(rows)
    assert found(merkle.manifest(spark.createDataFrame(rows[:1], DDL))) == brute(rows[:1])


def test_odd_rows_and_an_empty_table(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    extra = odd.selectExpr("*", "'x' AS leaf", "'x' AS skey", "'x' AS word", "'x' AS slots", "'x' AS top", "'x' AS whole")
    assert found(merkle.manifest(extra)) == brute(rows)
    assert merkle.manifest(spark.createDataFrame([], DDL)).collect() == []
