"""Quality rules, lines first: each line is judged by punctuation, navigation and boilerplate rules,
failing lines go, and a document that loses too much of its text is rejected.

A line without a punctuation mark passes if its paragraph (consecutive lines with words) has one, or if
its script is written without marks.

One pass over the documents, one text at a time; nothing is shuffled. Base measures are taken over
the whole original text; the verdict of the lines is the method's own.

A null text has no words, so it fails the base test and is rejected; so does a text without words.
Repeated rows are judged alike, each in its own row. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import ASCII_LOWER, LOWER, SPACED_WORD, UPPER, append_column, free_name, table, texts_of

# Characters and phrases of the line rules.
SYMBOLS = "[#*$%&|<>]"
STOPS = "[.!?:;…。！？؟।]"
SEPARATORS = "[|»›•>]"
BOILERPLATE = ["all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy",
               "use cookies", "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
               "click here", "sign up for our newsletter", "subscribe to our newsletter", "skip to content",
               "back to top", "powered by wordpress", "share on facebook", "follow us on"]
BOILERPLATE_WORDS = 25       # a longer line that names such a phrase is prose about it
UNSTOPPED_WORDS = 8          # a line of so many words needs a punctuation mark somewhere in its paragraph
# Marks beside STOPS, and scripts that are written without marks or with rare ones: Thai, Lao, Tibetan,
# Myanmar, Ethiopic, Khmer.
OTHER_MARKS = "[\u0589\u06D4\u0964\u0965\u0F0D\u0F0E\u104A\u104B\u1361-\u1368\u17D4-\u17D6\uFF0E\uFF1A\uFF1B\uFF61]"
UNSTOPPED_SCRIPTS = "[\u0E00-\u0FFF\u1000-\u109F\u1200-\u139F\u1780-\u17FF\u2D80-\u2DDF\uA9E0-\uA9FF\uAA60-\uAA7F]"
MIN_SEPARATORS = 3
MIN_WORDS = 50

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_kept_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
       T.StructField("clean_text", T.StringType())])
_ARROW = pa.struct([(n, pa.int64()) for n in RESULT.fieldNames()[:8]]
                   + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())])

_word, _symbol, _stop, _separator = map(re.compile, (SPACED_WORD, SYMBOLS, STOPS, SEPARATORS))
_other_mark, _unstopped = re.compile(OTHER_MARKS), re.compile(UNSTOPPED_SCRIPTS)
_phrase = re.compile("|".join(map(re.escape, BOILERPLATE)))


def has_mark(line: str, words: list[str]) -> bool:
    """Whether a line has a punctuation mark, or most of its words are of a script that needs none."""
    return bool(_stop.search(line) or _other_mark.search(line)
                or not line.isascii() and 2 * sum(bool(_unstopped.search(w)) for w in words) > len(words))


def marked_lines(lines: list[str], words: list[list[str]]) -> list[bool]:
    """Whether the paragraph of each line, the lines with words around it, has a mark: prose is wrapped anywhere."""
    out: list[bool] = []
    run, mark = 0, False
    for line, own in zip(lines, words, strict=True):
        if own:
            run += 1
            mark = mark or has_mark(line, own)
        else:
            out += [mark] * run + [False]
            run, mark = 0, False
    return out + [mark] * run


def line_fails(line: str, words: list[str], marked: bool | None = None) -> bool:
    """Whether one of the rules rejects a line with words; ``marked``: whether its paragraph has a mark (None: it is one itself)."""
    n = len(words)
    if 10 * len(_symbol.findall(line)) > 3 * n:                      # punctuation: symbols among the words
        return True
    if n >= 3 and 10 * line.count("!") > 5 * n:                      # punctuation: shouting
        return True
    # punctuation: no mark at all; a line that mostly repeats words can't use a mark of its paragraph
    if n >= UNSTOPPED_WORDS and not (marked and 2 * len(set(words)) > n or has_mark(line, words)):
        return True
    if (k := len(_separator.findall(line))) >= MIN_SEPARATORS and 10 * k > 3 * n:    # navigation
        return True
    if n >= UNSTOPPED_WORDS and 2 * max(Counter(words).values()) > n:                # one word fills the line
        return True
    return n <= BOILERPLATE_WORDS and bool(_phrase.search(line.translate(ASCII_LOWER)))


def judge(text: str, max_lost: float) -> dict:
    words = _word.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    repeat = covered = 0
    if len(seen) < len(windows):
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 3 - max(i, covered)
                covered = i + 3
    kept, kept_words, lines, dup, bad, earlier = [], 0, 0, 0, 0, set()
    every = text.split("\n")
    of_line = [_word.findall(line) for line in every]
    for line, own, marked in zip(every, of_line, marked_lines(every, of_line), strict=True):
        if not own:
            kept.append(line)
            continue
        lines += 1
        again = line in earlier
        dup += again
        earlier.add(line)
        if again or line_fails(line, own, marked):                           # boilerplate: a line said before
            bad += 1
        else:
            kept.append(line)
            kept_words += len(own)
    base_failed = n < MIN_WORDS or 100 * repeat > 50 * n
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(_symbol.findall(text)),
            "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_bad_lines": bad,
            "n_kept_words": kept_words, "base_failed": base_failed,
            "kept": not base_failed and n - kept_words <= max_lost * n,
            "clean_text": "\n".join(kept) if bad else text}


def line_quality(docs: DataFrame, name: str = "quality", max_lost: float = 0.5) -> DataFrame:
    """``docs`` with a RESULT column ``name`` (or name_1, ... if docs has that): base measures, line counts, verdict and the text of the lines
    that stay. ``max_lost``: the largest share of its words that a kept document may lose."""
    name = free_name(docs, name)

    def run(column):
        return pa.array([judge(t, max_lost) for t in texts_of(column)], type=_ARROW)
    return append_column(docs, name, RESULT, "text", run)


def clean(docs: DataFrame, **kw) -> DataFrame:
    """The kept documents with their cleaned text, and n_chars (if there) of it."""
    name = free_name(docs, "quality")
    out = line_quality(docs, name=name, **kw).where(F.col(name)["kept"]).withColumn("text", F.col(name)["clean_text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), name="q")
    return judged.select("doc_id", *[F.col("q")[f].alias(f) for f in RESULT.fieldNames() if f != "clean_text"],
                         F.md5(F.col("q")["clean_text"]).alias("clean_md5"))


QUERIES = {"op2_line_quality": op2_line_quality}

_PHRASES = "[" + ", ".join(f"'{p}'" for p in BOILERPLATE) + "]"
ORACLE_SQL = {"op2_line_quality": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '{SPACED_WORD}') AS w, string_split(text, chr(10)) AS lines FROM t),
b AS (SELECT *, list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM a),
grams AS (SELECT doc_id, gram, i FROM (SELECT doc_id, unnest(g) AS gram, unnest(range(0, len(g))) AS i FROM b)),
twice AS (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 3)) AS p FROM grams JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM a),
l1 AS (SELECT *, regexp_extract_all(line, '{SPACED_WORD}') AS lw, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l0),
p1 AS (SELECT *, regexp_matches(line, '{STOPS}') OR regexp_matches(line, '{OTHER_MARKS}')
    OR 2 * len(list_filter(lw, lambda w: regexp_matches(w, '{UNSTOPPED_SCRIPTS}'))) > len(lw) AS mark,
    count(*) FILTER (len(lw) = 0) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph FROM l1),
p2 AS (SELECT *, bool_or(mark) OVER (PARTITION BY doc_id, paragraph) AS marked FROM p1),
l2 AS (SELECT *, len(lw) AS n, len(lw) > 0 AND (again
    OR 10 * len(regexp_extract_all(line, '{SYMBOLS}')) > 3 * len(lw)
    OR (len(lw) >= 3 AND 10 * len(regexp_extract_all(line, '!')) > 5 * len(lw))
    OR (len(lw) >= {UNSTOPPED_WORDS} AND NOT mark AND NOT (marked AND 2 * len(list_distinct(lw)) > len(lw)))
    OR (len(regexp_extract_all(line, '{SEPARATORS}')) >= {MIN_SEPARATORS} AND 10 * len(regexp_extract_all(line, '{SEPARATORS}')) > 3 * len(lw))
    OR (len(lw) >= {UNSTOPPED_WORDS} AND 2 * list_max(map_values(list_aggregate(lw, 'histogram'))) > len(lw))
    OR (len(lw) <= {BOILERPLATE_WORDS} AND len(list_filter({_PHRASES}, lambda p: contains(translate(line, '{UPPER}', '{LOWER}'), p))) > 0)) AS bad FROM p2),
l3 AS (SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0 AND again) AS n_dup_lines,
              count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(n) FILTER (NOT bad), 0) AS n_kept_words,
              string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS clean FROM l2 GROUP BY doc_id),
m AS (SELECT a.doc_id, len(a.w) AS n_words, length(array_to_string(a.w, '')) AS word_chars,
             len(regexp_extract_all(a.text, '{SYMBOLS}')) AS n_symbols, l3.*, coalesce(rep.n, 0) AS n_repeat_words
      FROM a JOIN l3 USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines,
       n_bad_lines::BIGINT AS n_bad_lines, n_kept_words::BIGINT AS n_kept_words, base_failed,
       NOT base_failed AND n_words - n_kept_words <= 0.5 * n_words AS kept, md5(coalesce(clean, '')) AS clean_md5
FROM v"""}
