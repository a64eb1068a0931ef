"""Secret scan against a plain Python version over small and odd texts, and its randomness tests."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from setscore.llm import secrets as X
from tests.conftest import SF0001 as SMALL

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> list[tuple[int, int, str, int]]:
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


ODD = [None, "", " ", "password", "token=abc", "token=abcdef", "TOKEN : 'abc.def'", "secret=token:abcdef",
       "Api_Key==abcdef password=x secret: \"zzzzzzz\" tail", "AKIA" + "B" * 15, "AKIA" + "B" * 16, "xAKIAKIA" + "B" * 16,
       "é" * 30 + " \U0001F600 passwd=ünï abcdef password='secret12'", "deadbeef" * 3, "deadbee" * 3, "0" * 24,
       "password=deadbeefdeadbeefdeadbeef", "ſecret=abcdefg toKen=abcdefg", "x " * 60_000 + "token=abcdef", "password=" + "a" * 50_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[5]), (None, ODD[5]), (None, ODD[5])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("tested", F.lit("x"))


def test_base_spans_of_odd_texts(spark, odd):
    got = X.secret_spans(odd, keep=("doc_id", "text")).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert joined([(s.start, s.kind_no, s.kind, s.end) for s in r.base]) == joined(base(r.text or "")), r.text[:60]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in X.op3_random_secrets(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        b = base(d.text or "")
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in b) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined(b).encode()).hexdigest()
        assert set(joined(b).split(",")) <= set(r.spans.split(","))


def brute_battery(body: str, alphabet: str) -> float:
    n, k = len(body), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi2 = sum(body.count(c) ** 2 for c in set(body)) * k / n - n
    df = k - 1
    p1 = tail(((max(chi2, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    x = [alphabet.index(c) + 1 for c in body]
    high = [v > k / 2 for v in x]
    h = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * h * (n - h) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p2 = 0.0 if var <= 0 else 2 * tail(abs(runs - mean) / math.sqrt(var))
    m = sum(x) / n
    spread = sum((v - m) ** 2 for v in x)
    lag = sum((a - m) * (b - m) for a, b in zip(x, x[1:]))
    p3 = 0.0 if spread <= 1e-9 else 2 * tail(abs(lag / spread * math.sqrt(n) + 1 / math.sqrt(n)))
    s = -2 * sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-s / 2) * (1 + s / 2 + s * s / 8)


def test_battery_against_brute_force(spark):
    rng = random.Random(7)
    alphabet = X.ENCODINGS[-1][2]
    rows = [("".join(rng.choice(alphabet[:k]) for _ in range(n)),) for n in (20, 33, 64) for k in (2, 16, 64) for _ in range(4)] + [("A" * 30,)]
    df = spark.createDataFrame(rows, "body string")
    for r in df.select("body", X.battery(F.col("body"), F.lit(alphabet)).alias("p")).collect():
        assert r.p == pytest.approx(brute_battery(r.body, alphabet), abs=2e-6)


def test_band_cuts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(b, round(rng.random() ** w, 4)) for b, w in (("a", 6), ("b", 1), ("c", 3)) for _ in range(200)]
    want = {}
    for b in "abc":
        ps = sorted(p for x, p in rows if x == b)
        ok = [p for i, p in enumerate(ps, 1) if p <= X.LEVEL * sum(q <= p for q in ps) / len(ps)]
        if ok:
            want[b] = max(ok)
    got = {r.band: r.cut for r in X.band_cuts(spark.createDataFrame(rows, "band string, p double")).collect()}
    assert got == want


def test_random_tokens_found_structured_left(spark):
    rng = random.Random(5)
    letters = X.ENCODINGS[-1][2]
    rnd = lambda n: "A1b" + "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, f"see {rnd(40)} there") for i in range(100)]
    rows += [(100 + i, "at Aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1111111111 and Plainwordswithoutdigitsthatarelong") for i in range(100)]
    got = {r.doc_id: len(r.extra) for r in X.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(100)) >= 85
    assert sum(got[100 + i] for i in range(100)) == 0


def test_values_after_a_name_are_tokens(spark):
    rng = random.Random(11)
    rnd = lambda: "A1b" + "".join(rng.choice(X.ENCODINGS[-1][2][:62]) for _ in range(40))
    forms = ["x;AccountKey={}==;EndpointSuffix=core", "https://h.example/c?sv=1&sig={}&se=2", "auth={}", "export KEYVALUE={}\n", "a={}=", "{}=={}="]
    rows = [(i, f.replace("{}", rnd(), 1).replace("{}", rnd())) for i, f in enumerate(forms)]
    want = {i: [m.group() for m in re.finditer(r"A1b[A-Za-z0-9]{40}(=+(?![A-Za-z0-9=]))?", t)] for i, t in rows}
    got = {r.doc_id: [s.value for s in r.extra] for r in X.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # of the last form's two tokens one looks structured by chance (p = 0.0015), so only the pattern is asked
    assert {i: got[i] for i in range(5)} == {i: want[i] for i in range(5)}
    assert re.findall(X.TOKEN, rows[5][1]) == want[5] and len(want[5]) == 2


def test_redact_and_empty_table(spark, odd):
    got = {r.doc_id: r.text for r in X.redact(odd.where("doc_id >= 4 and doc_id <= 5")).collect()}
    assert got == {4: "token=abc", 5: "[assign]"}
    assert X.secret_spans(odd.where("false")).collect() == []


def test_one_structured_token_among_many_random_ones(spark):
    rng = random.Random(21)
    letters = X.ENCODINGS[-1][2]
    rows = [(i, f"see A1b{''.join(rng.choice(letters) for _ in range(40))} there") for i in range(10_000)]
    strong = "A1b" + "abc" * 13 + "a"
    assert brute_battery(strong, letters) < 1e-6
    rows.append((10_000, f"see {strong} there"))
    got = {r.doc_id: len(r.extra) for r in X.secret_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got[10_000] == 0 and sum(got.values()) > 9_400
    p = spark.createDataFrame([(1e-30,), (1e-6,), (0.0499,), (1.0,), (0.0,)], "p double").select(F.col("p"), X.rounded_up(F.col("p")).alias("r")).collect()
    assert all(max(r.p, 1e-300) * 0.9999 <= r.r <= max(r.p, 1e-300) * 1.024 for r in p)


def test_false_reports_of_structured_names(spark):
    """Dates, paths, slugs, versions and camel-case names beside random tokens: the share that is reported stays small."""
    rng = random.Random(4)
    words = "quarter report final index render widget invoice customer archive module driver station harbour".split()
    w = lambda: rng.choice(words)
    plain = ([f"{w()}-{w()}-{w()}-2024-{m:02d}-{d:02d}" for m in range(1, 6) for d in range(1, 11)]
             + [f"/usr/lib/{w()}/{w()}/{w()}.{k}" for k in range(10, 60)] + [f"{w().title()}{w().title()}{w().title()}Service{k}" for k in range(50)]
             + [f"https/{w()}/{w()}/{w()}/page{k}" for k in range(50)])
    letters = X.ENCODINGS[-1][2][:62]
    rows = [(i, f"x {t} y") for i, t in enumerate(plain)] + [(1000 + i, "x A1b" + "".join(rng.choice(letters) for _ in range(40)) + " y") for i in range(1000)]
    got = {r.doc_id: len(r.extra) for r in X.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    false = sum(got[i] > 0 for i in range(len(plain)))
    print("false reports", false, "of", len(plain), "found", sum(got[1000 + i] for i in range(1000)))
    assert false <= 0.2 * len(plain) and sum(got[1000 + i] for i in range(1000)) >= 900


def test_spans_in_linear_time(spark):
    import time
    def run(n):
        text = " ".join(f"token=abc{i:06d} {i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        r = X.secret_spans(df, keep=("doc_id", "text")).first()
        assert joined([(s.start, s.kind_no, s.kind, s.end) for s in r.base]) == joined(base(text))
        return time.time() - t
    run(100)
    assert run(50_000) < 30


def test_tokens_beside_base_spans(spark):
    """Against the definition: tokens that overlap no base span, over random spans of one text."""
    from setscore.llm import spans as S
    rng = random.Random(9)
    rows = []
    for i in range(40):
        cuts = sorted(rng.sample(range(60), 12))
        own = [(a, 3, "random", b, "t") for a, b in zip(cuts[::2], cuts[1::2])]
        other = sorted((a, k, "hex", a + rng.randint(1, 9), "o") for k in range(3) for a in rng.sample(range(60), rng.randint(0, 2)))
        rows.append((i, own, other))
    df = spark.createDataFrame(rows, f"i int, own {S.SPAN_TYPE}, other {S.SPAN_TYPE}")
    for r in df.select("own", "other", S.beside(F.col("own"), F.col("other")).alias("got")).collect():
        assert [s.start for s in r.got] == [s.start for s in r.own if not any(o.start < s.end and s.start < o.end for o in r.other)]
