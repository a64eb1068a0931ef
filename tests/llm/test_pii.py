"""Entities and disclosing terms against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from setscore.llm import pii as X
from tests.conftest import SF0001 as SMALL


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text: str) -> list[tuple[int, int, str, int]]:
    digits = lambda m: re.sub("[^0-9]", "", m)
    find = lambda no, kind, pat, ok: [(no, m.start(), kind, m.end()) for m in re.finditer(pat, text) if ok(m[0])]
    return (find(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True)
            + find(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split(".")))
            + find(2, "card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)))
            + find(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for _, a, k, b in spans)


ODD = [None, "", "a@b.c", "a@b.c_d@e.f", "a@b.c@d.e", "x a.b+c@d-e.f.g. y", "@", "a@", "é@b.c ü", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4",
       "000000000000000000000000000000000000000000001.2.3.255", "4539 1488 0343 6467", "4539-1488-0343-6467 4539148803436467", "45391488034364670",
       "4539  1488", "+1 (988) 555-2485", "+12", "+1 2", "++1 234 567 89 x+44.20.7946.0958.", "\U0001F600 mail a@b.co \U0001F600 +1 (988) 555-2485",
       "+1234567890123456", "a" * 30_000 + "@b.c", "1 " * 20_000, "z" * 20_000 + " @ ip 10.0.0.1"]


def test_base_spans_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, ODD[2]), (2, ODD[2]), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(0)).withColumn("base", F.lit(0)).withColumn("marks", F.lit("x")).withColumn("parts", F.lit(3))
    got = X.disclosing_spans(df, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert joined([(s.kind_no, s.start, s.kind, s.end) for s in r.base]) == joined(base(r.text or "")), (r.text or "")[:60]
    assert X.disclosing_spans(df.where("false")).collect() == []


def brute_terms(docs: list[str]) -> dict[str, list[tuple[int, int, str]]]:
    """Spans with action by text, from the definitions."""
    word = re.compile(r"[^\W_]+")
    n = len(docs)
    n_term, n_entity, pairs, texts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    occ = defaultdict(set)
    for t in docs:
        for w in {m[0].translate(str.maketrans(X.UPPER, X.LOWER)) for m in word.finditer(t)}:
            n_term[w] += 1
        ents = base(t)
        for e in {(k, t[a:b]) for _, a, k, b in ents}:
            n_entity[e] += 1
        seen = set()
        for _, a, k, b in ents:
            for m in word.finditer(t):
                w = m[0].translate(str.maketrans(X.UPPER, X.LOWER))
                seen.add((k, t[a:b], w))
                occ[t].add((k, t[a:b], w, m.start(), m.end()))
        for p in seen:
            pairs[p] += 1
            texts[p].add(t)
    out = {}
    for t in docs:
        spans = {}
        for k, v, w, a, b in occ[t]:
            if len(texts[k, v, w]) < X.SUPPORT or any(x < b and a < y for _, x, _, y in base(t)):
                continue
            ic = math.log2(n / n_entity[k, v])
            if ic <= 0:
                continue
            share = 1 - math.log2(n_term[w] / min(pairs[k, v, w], n_term[w])) / ic
            if share >= X.GENERALISE:
                spans[a, b] = max(spans.get((a, b), ""), "remove" if share >= X.REMOVE else "generalise")
        out[t] = sorted((a, b, act) for (a, b), act in spans.items())
    return out


@pytest.fixture(scope="module")
def revealing():
    docs = [f"the plain line {i} of words and more words in it" for i in range(40)]
    docs += [f"agent Zorblax at desk {i} mail z@spy.org the and words" for i in range(4)]
    docs += ["agent Zorblax at desk 2 mail z@spy.org the and words"] * 5
    far = "filler of the plain line and more words " * 6
    docs += [f"Quexel {i} {far} mail q@far.org {far} and Quexel again, quexel. far" for i in range(4)]
    docs += [f"words {i} agent on line +1 (988) 555-2485 the end 10.0.0.1 zz" for i in range(3)]
    return docs + ["once only y@spy.org rareword here", ""]


def test_terms_against_brute_force(spark, revealing):
    want = brute_terms(revealing)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(revealing)], "doc_id long, text string")
    got = X.disclosing_spans(df, keep=("doc_id", "text")).collect()
    assert any(want.values())
    # a name far from its address, at all of its places
    far = [(t, {a for a, _, _ in v}) for t, v in want.items() if t.startswith("Quexel")]
    assert len(far) == 4 and all({m.start() for m in re.finditer("(?i)quexel", t)} <= places for t, places in far)
    for r in got:
        assert [(s.start, s.end, s.kind) for s in r.terms] == want[r.text], r.text


def test_sanitise(spark, revealing):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(revealing)] + [(999, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in X.sanitise(df).collect()}
    assert got[999] is None and got[0] == revealing[0] and "[email]" in got[40] and "Zorblax" not in got[40]
    assert "rareword" in got[len(revealing) - 2]
    assert not any("quexel" in (t or "").lower() for t in got.values())


def test_pairs_of_a_text_dealt_over_tasks(spark, revealing, monkeypatch):
    monkeypatch.setattr(X, "PAIRS", 7)
    want = brute_terms(revealing)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(revealing)], "doc_id long, text string")
    for r in X.disclosing_spans(df, keep=("doc_id", "text")).collect():
        assert [(s.start, s.end, s.kind) for s in r.terms] == want[r.text], r.text


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in X.op6_disclosure(spark, SMALL).collect()}
    terms = brute_terms([d.text or "" for d in docs])
    assert len(got) == len(docs)
    for d in docs:
        b = base(d.text or "")
        r = got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in b) for k in X.KINDS)
        assert r.base_sha256 == hashlib.sha256(joined(b).encode()).hexdigest()
        assert r.spans == ",".join(filter(None, [joined(b), *[f"term:{s}:{e}" for s, e, _ in terms[d.text or ""]]]))
