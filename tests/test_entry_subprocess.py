"""The driver contract loads from any working directory in a fresh interpreter."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", sys.argv[1])
mod = importlib.util.module_from_spec(spec); spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
df = mod.entry(spark)
rows = df.collect()
qs, sql = mod.queries(), mod.oracle_sql()
n = qs["pseudobulk_text"](spark, "/root/testdata/sf0.001").count()
print("OK", len(rows), len(qs), len(sql), n)
"""


import pytest


@pytest.mark.parametrize("bare_conf", [False, True])
def test_entry_from_foreign_cwd(bare_conf):
    """Also with no Spark defaults at all, so no checkpoint folder is preset."""
    with tempfile.TemporaryDirectory(prefix="setscore-cwd-") as cwd:
        env = dict(os.environ)
        if bare_conf:
            env["SPARK_CONF_DIR"] = cwd
        out = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(REPO, "__spark_entry__.py")],
                             cwd=cwd, capture_output=True, text=True, timeout=900, env=env)
    last = [ln for ln in out.stdout.splitlines() if ln.startswith("OK")]
    assert last, out.stderr[-3000:]
    _, rows, nq, nsql, n_pb = last[0].split()
    assert int(rows) == 500 and int(nq) >= 40 and int(nsql) >= 38 and int(n_pb) > 0
