"""Every registered query against its DuckDB oracle at sf0.001 (the driver runs sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from setscore.plans.catalog import ORACLE_SQL, QUERIES
from tools.check_oracle import TABLES, canon

from .conftest import SF0001


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF0001).toPandas()
    assert len(got) > 0
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    want = con.execute(sql).df()
    assert len(got) == len(want)
    assert canon(got) == canon(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["aggregated_sample_cell_type", "sample", "cell_type", "timepoint", "response",
                          "gene_sig_score_1", "gene_sig_score_2"]
    assert df.count() == 500


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql()) <= set(E.queries())


def test_rewritten_input_gives_new_scores(spark, tmp_path):
    """Scores are shared only while the input's files stay as they are."""
    from setscore.plans import catalog
    source = spark.read.parquet(f"{SF0001}/embeddings.parquet").where("vec_id < 40")
    path = str(tmp_path / "embeddings.parquet")
    source.write.parquet(path)
    first = catalog.QUERIES["score_long"](spark, str(tmp_path)).count()
    source.where("vec_id < 20").write.mode("overwrite").parquet(path)
    assert (first, catalog.QUERIES["score_long"](spark, str(tmp_path)).count()) == (80, 40)


@pytest.mark.parametrize("name", ["pseudobulk_star", "kernel_cdf", "score_corr_both", "heatmap_celltype_timepoint"])
def test_query_independent_of_shuffle_width(spark, name):
    """Same rows whatever the shuffle width (the score cache is bypassed by a fresh folder key)."""
    fn = E.queries()[name]
    base = canon(fn(spark, SF0001).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        from setscore.plans import catalog
        catalog._SCORES.clear()
        other = canon(fn(spark, SF0001).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == other
