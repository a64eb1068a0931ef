"""Upload-triggered scoring stream equals batch scoring of the same files."""

import os
import tempfile
import uuid

from setscore.operators.scoring import score_gene_sets
from setscore.sources import fixtures as fx
from setscore.sources.gene_sets import read_gene_sets, score_sets
from setscore.streaming.uploads import score_uploads

from .conftest import SF0001


def test_stream_scores_each_upload(spark):
    base = tempfile.mkdtemp(prefix="setscore-stream-")
    up, out = os.path.join(base, "up"), os.path.join(base, "out")
    os.makedirs(up)
    files = {"a.csv": "\ufeffg1,g2,extra\r\nD00,D08,x\r\nD01,D09,y\r\nD02,,z",
             "b.csv": "s1,s2\nD10,D03\nD11,ZZ\n"}
    for name, text in files.items():
        with open(os.path.join(up, name), "w", encoding="utf-8", newline="") as fh:
            fh.write(text)
    expr = fx.expr_dense(spark, SF0001).cache()
    # a stream's identity is its checkpoint: a stable name resumes, so each test run uses its own
    q = score_uploads(spark, expr, up, out, query_name=f"test_uploads_{uuid.uuid4().hex}")
    q.awaitTermination(600)
    got = spark.read.parquet(out).collect()
    assert {os.path.basename(r["upload"]) for r in got} == {"a.csv", "b.csv"}
    for name in files:
        want = {(r["unit"], r["set_name"]): r["score"]
                for r in score_gene_sets(expr, score_sets(read_gene_sets(spark, os.path.join(up, name)))).collect()}
        have = {(r["unit"], r["set_name"]): r["score"] for r in got if os.path.basename(r["upload"]) == name}
        assert have.keys() == want.keys() and max(abs(have[k] - want[k]) for k in want) < 1e-12
