"""Quality rules, licences and language over odd rows and small cases; query against SQL is the driver's check."""

from __future__ import annotations

import itertools
import re
import time
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from setscore.llm import langid, licenses, line_quality
from tests.conftest import SF0001, SF001
from tests.llm.conftest import ROWS


# -- quality ------------------------------------------------------------------------------------

def test_quality_of_odd_rows(spark, odd):
    out = line_quality.line_quality(odd)
    got = sorted((str(r.doc_id), r.quality_1.n_words, r.quality_1.n_dup_lines, r.quality_1.kept) for r in out.select("doc_id", "quality_1").collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ROWS)]
    assert ("9", 240, 59, False) in got
    kept = line_quality.clean(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {None, 5, 7}
    assert line_quality.clean(odd.where("false")).collect() == []


def test_sql_of_paragraphs_and_scripts(spark, tmp_path):
    """Texts on which a line's own mark and its paragraph's differ, in Spark and in SQL."""
    line = "a wrapped line of clean prose that goes on here"
    thai = " ".join(chr(0x0E01 + k) * 3 for k in range(9))
    texts = [f"{line} one\n{line} two\n{line} three, and ends.\n" * 1 + f"\n{line} four\n{line} five\n" * 3, f"{line} one\n\n{line} two\n  \nEnd of it all. " * 4,
             "\n".join(f"{thai} {k}" for k in "abcdefgh"), "\n".join([f"{line} {k}" for k in range(9)] + ["It ends."]), "go go go stop go go go stop\nA sentence of words here.\n" * 5,
             "\n".join(f"go go stop stop run run {k} {k} now now\nIt ends {k}." for k in range(9)), f"{line}\u06d4\n" + f"{line} x\n" * 8, None, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = line_quality.op2_line_quality(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(line_quality.ORACLE_SQL["op2_line_quality"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted([tuple(r[n] for n in names) for r in got]) == sorted(want)
    lost = {r.doc_id: r.n_bad_lines for r in got}
    assert lost[0] > 0 and lost[1] > 0 and lost[2] == lost[3] == 0 and lost[4] > 0 and lost[5] > 0


def test_line_rules():
    bad = ["$$$ buy ### now ***", "STOP!! READ!! THIS!!", "home | about | contact | more", "one two three four five six seven eight nine",
           "We use cookies on this site.", "go go go go go go go stop here."]
    good = ["A plain sentence of words.", "The.", "It costs $5 to get in there.", "We use cookies " + "in our long recipe for a cake " * 5 + "."]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(line_quality.line_fails(t, words(t)) for t in bad) and not any(line_quality.line_fails(t, words(t)) for t in good)


def test_lines_go_before_the_document():
    body = [f"Line{i} says{i} something{i} of its own{i}." for i in range(20)]
    r = line_quality.judge("\n".join(["a | b | c | d", *body]), 0.5)
    assert r["kept"] and r["clean_text"] == "\n".join(body) and r["n_bad_lines"] == 1
    r = line_quality.judge("\n".join([f"row{i} | b{i} | c{i} | d{i}" for i in range(60)] + body), 0.5)
    assert not r["kept"] and not r["base_failed"]


def test_wrapped_prose_and_unpunctuated_scripts_are_kept():
    words = [f"word{i}" for i in range(300)]
    sentences = [" ".join(words[i:i + 30]) + "." for i in range(0, 300, 30)]
    wrapped = "\n\n".join("\n".join(textwrap.wrap(" ".join(sentences[i:i + 2]), 60)) for i in range(0, 10, 2))
    r = line_quality.judge(wrapped, 0.5)
    assert r["kept"] and r["n_bad_lines"] == 0 and r["clean_text"] == wrapped
    for letters in ("\u0E01\u0E02\u0E04\u0E07\u0E08", "\u1200\u1210\u1218\u1230\u1240", "\u1780\u1781\u1782\u1783\u1784"):
        own = ["".join(p) for p in itertools.product(letters, repeat=3)]
        text = "\n\n".join(" ".join(own[i:i + 10]) for i in range(0, 120, 10))
        r = line_quality.judge(text, 0.5)
        assert r["kept"] and r["clean_text"] == text
    # a paragraph without any mark still goes
    r = line_quality.judge("home news about contact shop cart login help\nmore of these words in a row without marks\n\n" + wrapped, 0.5)
    assert r["n_bad_lines"] == 2 and r["clean_text"] == "\n" + wrapped


def test_repeat_words_cover_windows_once():
    assert line_quality.judge("a b c d a b c e", 0.5)["n_repeat_words"] == 6
    assert line_quality.judge("a a a a", 0.5)["n_repeat_words"] == 4
    assert line_quality.judge("a b c d", 0.5)["n_repeat_words"] == 0


# -- licences -----------------------------------------------------------------------------------

def brute_base(text: str) -> list[tuple[int, str]]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(licenses.ASCII_LOWER))
    return [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]


def test_base_places_of_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = licenses.op4_ordered_signatures(spark, SF001).collect()
    assert len(got) == len(docs) and any(r.n_base for r in got)
    for r in got:
        b = brute_base(docs[r.doc_id])
        assert (r.n_base, r.first_word, r.last_word) == (len(b), min(b)[0] if b else None, max(b)[0] if b else None)
        assert r.base_labels == ",".join(sorted({x for _, x in b})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize(("text", "labels"), [
    ("Under the MIT license, CC-BY-NC; Apache License, Version 2.0", ["apache-2", "cc-by-nc", "mit"]),
    ("cc by nc by nc cc", ["cc-by-nc"]), ("Licensed under the GNU Lesser General Public License v2.1", ["lgpl-2.1"]),
    ("SPDX-License-Identifier: MPL-2.0", ["mpl-2.0"]), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
    ("permit the licence of summits", []), ("", []), ("GNU General Public License, version 3.", ["gpl-3.0"])])
def test_labels(text, labels):
    assert licenses.Scanner().scan(text)["labels"] == labels


def example(pattern: str) -> str:
    """A text that a licence's name pattern matches."""
    pattern = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", pattern)
    return re.sub(r"\bV\b", "version", pattern.replace("LIC", "license")).replace(" ?", " ").replace("?", "").replace("[1-4]", "4")


@pytest.mark.parametrize("gap", ["\n * ", "  ", "\n# ", "\r\n//", "-", " "])
def test_prefilter_is_necessary(gap):
    scanner = licenses.Scanner()
    missed = []
    for label, _, name, url in licenses.LICENSES:
        for text in (f"spdx license identifier {label}", f"licensed under the {example(name)}", f"https://www.{url}", f"license is {example(name)}", example(name)):
            low = text if url in text else text.replace(" ", gap)
            off = scanner.detections(low, prefilter=False)
            if not off or scanner.detections(low) != off:
                missed.append((label, low))
    assert missed == []


def test_wrapped_header():
    assert licenses.Scanner().scan("This is under the GNU General\n * Public License, version 3 of it")["labels"] == ["gpl-3.0"]


def test_rules_find_their_own_names_and_none_overlap():
    s = licenses.Scanner()
    assert len(s.rules) >= 200
    for label, *_ in licenses.LICENSES:
        assert label in s.scan(f"SPDX-License-Identifier: {label}")["labels"]
    many = s.detections("licensed under the mit license. gnu affero general public license version 3 " * 200)
    assert len(many) == 400 and all(a[1] <= b[0] for a, b in zip(many, many[1:]))


def words_of_signature(pattern: str) -> list[str]:
    """The words of a text that a signature matches."""
    pattern = re.sub(r"\(\?!.*\)$", "", pattern).replace("~", " some other words ")
    while (less := re.sub(r"\(\?:([^()|]*)(?:\|[^()|]*)*\)\??", r"\1", pattern)) != pattern:
        pattern = less
    pattern = re.sub(r"\bV\b", "version", pattern.replace("LIC", "license")).replace(" ?", " ").replace("?", "").replace("\\+", "+")
    return re.sub(r"\[(.)[^\]]*\]", r"\1", pattern).split()


SIGNATURES = [(kind, label, text) for kind, own, *_ in licenses.SIGNATURES for label, _, text in own]


@pytest.mark.parametrize("gap", [" ", "\n * ", "\n    // ", ", "])
def test_every_signature_finds_its_text_and_no_other(gap):
    s = licenses.Scanner()
    for kind, label, text in SIGNATURES:
        w = words_of_signature(text)
        found = s.detections(f"see: {gap.join(w)}.")
        assert f"{label}/{kind}" in {d[3] for d in found}, (label, w, found)
        assert found == s.detections(f"see: {gap.join(w)}.", prefilter=False)
        if len(w) > 6:                 # one word is another: prose that resembles it
            broken = gap.join(w[:1] + ["never"] + w[2:])
            assert f"{label}/{kind}" not in {d[3] for d in s.detections(broken)}, (label, broken)
    assert len(s.rules) >= 400


@pytest.mark.parametrize(("text", "labels"), [
    ("SPDX-License-Identifier: GPL-2.0-or-later OR MIT", ["gpl-2.0-or-later", "mit"]),
    ("// SPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception AND BSD-3-Clause)", ["apache-2", "bsd-3-clause"]),
    ('"license": "ISC",', ["isc"]), ("license = 'Apache-2.0 OR MIT'", ["apache-2", "mit"]), ("license: their own", []),
    ("SPDX-License-Identifier: GPL-2.0+", ["gpl-2.0-or-later"]), ("SPDX-License-Identifier: LGPL-2.1-only", ["lgpl-2.1"]),
    ("GPLv2", ["gpl-2.0"]), ("GPL v3 or later", ["gpl-3.0-or-later"]), ("Licensed under CC BY.", ["cc-by"]), ("CC BY 4.0", ["cc-by"]),
    ("open rail network tickets", []), ("send a cc by email", []), ("OpenRAIL-M", ["openrail-m"]), ("open rail license", ["openrail-m"]),
    ("The permission to use the pool is hereby granted to guests.", []), ("redistribution of income and use of binary forms", []),
    ("either version of the story, or any later version", []), ("a free copyleft of sorts", []),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", ["cc-by-nc-nd"])])
def test_expressions_notices_and_prose(text, labels):
    assert licenses.Scanner().scan(text)["labels"] == labels


def test_longer_bodies_suppress_what_they_hold():
    head = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n"
    third = "# Neither the name of the owner nor the names of its contributors may be used to endorse or promote products\n"
    s = licenses.Scanner()
    assert s.scan(head)["labels"] == ["bsd-2-clause"]
    assert s.scan(f"{head}# {'1. Source keeps this notice. ' * 20}\n{third}")["labels"] == ["bsd-3-clause"]
    start = time.monotonic()
    assert len(s.scan((head + "other words stand here " * 50) * 2_000)["places"]) == 2_000 and time.monotonic() - start < 30


def test_license_scan_of_odd_rows(spark, odd):
    out = licenses.license_scan(odd)
    assert out.count() == len(ROWS) and licenses.license_scan(odd.where("false")).collect() == []
    assert out.where("text IS NULL").select("license_1.n_words", "license_1.score", "license_1.first_word").first() == (0, 0.0, None)


# -- language -----------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    got = langid.op5_crf_language(spark, SF001).join(truth, "doc_id").where("held_out AND lang IS NOT NULL")
    n, right, low, high = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert n > 200 and right / n > 0.97 and low >= 0 and high <= 1


def test_code_switching_and_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    chain = langid.fit(langid.sample(docs))
    en, fr = (docs.where(f"lang = '{x}' AND length(text) > 400").orderBy("doc_id").first().text.replace("\n", " ")[:300] for x in ("en", "fr"))
    r = langid.label_texts([f"{en} {fr}".encode()], chain)[0]
    assert r["segments"][0]["lang"] == "en" and r["segments"][-1]["lang"] == "fr"
    assert r["segments"][-1]["end"] == r["n_words"]
    out = langid.identify(odd, chain)
    rows = {str(x.doc_id): x.language_1 for x in out.select("doc_id", "language_1").collect()}
    assert out.count() == len(ROWS) and rows["0"].lang == rows["1"].lang == rows["2"].lang == "und" and rows["0"].score == 0
    assert langid.identify(odd.where("false"), chain).collect() == []
    assert langid.label_texts(["… —".encode()], chain)[0]["lang"] == "und"
    empty = langid.fit(langid.sample(odd.where("lang = 'xx'")))
    assert {x.language_1.lang for x in langid.identify(odd, empty).select("language_1").collect()} == {"und"}


def test_every_language_has_its_own_sample(spark):
    """A hot document takes one place; a language of long texts only is learned; reruns choose alike."""
    rows = [(0, "the hot one of many rows", "en")] * 3_000 + [(i, f"ein Satz Nummer {i} und mehr", "de") for i in range(1, 301)]
    rows += [(i, f"una frase numero {i} " * 2_000, "es") for i in range(301, 320)] + [(400, None, "xx"), (401, "", "xx"), (402, "12 34", "xx"), (None, "no id", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.sample(df)
    usable = lambda lang: len({(i, t) for i, t, g in rows if g == lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1})
    count = Counter(lang for _, lang in got)
    assert count == {lang: min(langid.SAMPLE_DOCS, usable(lang)) for lang in ("en", "de", "es")} and count["es"] > 5
    assert max(len(t) for t, _ in got) == langid.SAMPLE_CHARS and got == langid.sample(df.repartition(3))


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(2)
    emission, steps = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    begin, length = np.array([0, 4]), np.array([4, 3])
    prob, counts = langid.forward_backward(emission, steps, begin, length, count=True)
    want, steps_want = np.zeros((7, 3)), np.zeros((3, 3))
    for b, n in zip(begin, length, strict=True):
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([np.exp(sum(emission[b + t, y] for t, y in enumerate(p)) + sum(steps[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        for p, s in zip(paths, score / score.sum(), strict=True):
            for t, y in enumerate(p):
                want[b + t, y] += s
            for x, y in zip(p, p[1:]):
                steps_want[x, y] += s
    assert np.allclose(prob, want) and np.allclose(counts, steps_want)
