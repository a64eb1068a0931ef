"""Rows that every operator must bear: nulls, empty and long texts, repeated rows, clashing columns."""

import pytest

LONG = "The quick brown fox jumps over the lazy dog. " * 8_000
TEXTS = [None, "", " \n\t ", "one", "Ünï cödé \U0001F600 words.", "same text of two rows here.", "same text of two rows here.", LONG,
         "a" * 60_000, "line one is here.\n" * 60, "x\x0by\x0cz\rw\n\n|||| $$$$ ####"]
ROWS = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"src{i % 3}", 0) for i, t in enumerate(TEXTS)] + [
    (None, None, None, None, None), (None, "no id. " * 30, "en", "src1", 1), (5, TEXTS[5], "en", "src2", 0), (5, TEXTS[5], "en", "src2", 0), (5, "another text. " * 20, "de", "src2", 0)]


@pytest.fixture(scope="session")
def odd(spark):
    """``documents`` with odd rows, and columns whose names operators use inside."""
    clash = ["result", "quality", "contamination", "row", "hash", "key", "shard", "slot", "size", "record", "place", "bucket", "fp", "language", "license", "row_key", "text_hash", "n", "target", "start", "copies"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"'{c}!' AS {c}" for c in clash], "map('a', 1) AS m")
