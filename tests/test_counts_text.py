"""counts_text: rows against a plain count on odd documents, and the plan of its pseudobulk."""

import re
from collections import Counter

from setscore.plans.catalog import QUERIES
from setscore.sources import fixtures as fx

from .conftest import SF0001

DOCS = [
    (1, "b a b\ta  a\na"), (2, None), (3, ""), (4, " \r\n\t "), (5, "x"), (6, " lead trail "), (7, "A a \u00e9 \u00c9 \u00a0 \u6f22 \U0001f600 a"),
    (8, "same doc"), (8, "same words doc"), (8, None), (9, None), (9, "last"), (None, "no id"), (None, "id"),
    (10, "w " * 20_000 + "v"),
]


def test_counts_of_odd_documents(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for doc_id, text in DOCS:
        want.update((w, None if doc_id is None else str(doc_id)) for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w)
    got = fx.counts_text(spark, str(tmp_path))
    assert got.columns == ["gene", "cell_id", "value"] and dict(got.dtypes)["value"] == "double"
    rows = got.collect()
    assert len(rows) == len(want) and {(r.gene, r.cell_id): r.value for r in rows} == want


def test_words_are_not_dealt_before_the_cells_meet_them(spark):
    """Between the words and their join with the cells: no exchange, no sort, no aggregate; the runs are worked out once."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["pseudobulk_text"](spark, SF0001)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join = next(i for i, line in enumerate(plan) if re.search(r"Join \[cell_id", line))
    words = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert join < words and not re.search("Exchange|Sort|Aggregate", "\n".join(plan[join + 1:words]))
    assert sum("lambdafunction" in line for line in plan) == 1
