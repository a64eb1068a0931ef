"""Driver tables mapped onto the single-cell domain.

The driver ships TPC-H-like parquet tables; these builders turn them into the
domain frames the operators take (see FIXTURES.md §2):

* dense  - ``embeddings`` as a complete gene x unit matrix (64 genes).
* star   - ``orders`` as cells, ``part`` names as genes, ``lineitem`` as counts.
* text   - ``documents`` as cells, words as genes.
* mouse  - ``embeddings`` again, with mouse-style unit names.

All builders are lazy DataFrame plans over the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Cluster names of the dense fixture, indexed by embeddings.label.
HUMAN_FIXTURE_CLUSTERS = [
    "AntigenPresentation", "InterferonAlphaBetaResponse", "Melanocytic",
    "Mesenchymallike", "Mitochondriallowquality", "Mitotic",
    "NeuralCrestlike", "PatientspecificA", "PatientspecificB",
    "StressHypoxiaResponse",
]

# Mouse cell-type names of the mouse fixture, indexed by label;
# labels 8 and 9 both map to the last entry.
MOUSE_FIXTURE_CELLTYPES = [
    "B-cell", "CAF", "DC", "EC", "Malignant", "Monocyte/macrophage",
    "Pericyte", "T/NKcell", "Unknown",
]

# The toy gene sets of the dense fixture, ragged like the
# shipped two-column CSV (second column shorter, one unknown gene "ZZ").
DEMO_GENE_SET_1 = ["D00", "D01", "D02", "D03", "D04", "D05", "D06"]
DEMO_GENE_SET_2 = ["D08", "D09", "D10", "D11", "D12", "ZZ"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(key: Column, values: list[str]) -> Column:
    """CASE key WHEN 0 THEN values[0] ... ELSE values[-1] END."""
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def units_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, unit): human composite names cluster_response_timepoint_ident_patient_count."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    v = F.col("vec_id")
    response = (F.when(v % 5 == 0, "NA").when(v % 2 == 0, "Responders").otherwise("NonResponders"))
    timepoint = F.when(v % 3 == 0, "BT").otherwise("OT")
    unit = F.concat(
        _lookup(F.col("label"), HUMAN_FIXTURE_CLUSTERS), F.lit("_"), response, F.lit("_"), timepoint,
        F.lit("_S"), (v % 20).cast("string"), F.lit("_GC"), (v % 7).cast("string"),
        F.lit("_"), (v + 1).cast("string"))
    return e.select("vec_id", "label", unit.alias("unit"))


def units_mouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, unit): mouse composite names celltype_sample_count."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    v = F.col("vec_id")
    unit = F.concat(_lookup(F.col("label"), MOUSE_FIXTURE_CELLTYPES), F.lit("_S"),
                    (v % 20).cast("string"), F.lit("_"), (v + 1).cast("string"))
    return e.select("vec_id", unit.alias("unit"))


def _expr_from_embeddings(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    long = e.select("vec_id", F.concat(F.lit("D"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene"),
                    F.col("x").cast("double").alias("value"))
    # units is one row per embeddings row: a narrow key-preserving join on vec_id.
    return long.join(units.select("vec_id", "unit"), "vec_id").select("unit", "gene", "value")


def expr_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, gene, value): complete 64-gene matrix, human names."""
    return _expr_from_embeddings(spark, sf_dir, units_dense(spark, sf_dir))


def expr_mouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, gene, value): complete 64-gene matrix, mouse names."""
    return _expr_from_embeddings(spark, sf_dir, units_mouse(spark, sf_dir))


def expr_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative variant for heatmaps: greatest(value, 0) * 100, so zero means occur."""
    return expr_dense(spark, sf_dir).withColumn("value", F.greatest(F.col("value"), F.lit(0.0)) * 100)


def cells_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ck = F.col("o_custkey")
    return o.select(
        F.col("o_orderkey").cast("string").alias("cell_id"),
        F.col("o_orderpriority").alias("cluster"),
        F.when(ck % 3 == 0, "Responders").when(ck % 3 == 1, "NonResponders").alias("response"),
        F.when(F.col("o_orderstatus") == "F", "BT").when(F.col("o_orderstatus") == "O", "OT").alias("timepoint"),
        F.concat(F.lit("S"), (ck % 4).cast("string")).alias("ident"),
        F.concat(F.lit("GC "), (ck % 2).cast("string")).alias("patient"),
    )


def counts_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, cell_id, value) non-zero triples: part names as genes, order lines as counts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    sep = F.when(F.col("p_size") % 3 == 0, ".").when(F.col("p_size") % 3 == 1, "-").otherwise("")
    gene = F.concat(F.col("p_brand"), sep, F.col("p_type"))
    j = li.join(part, li.l_partkey == part.p_partkey)
    return (j.groupBy(gene.alias("gene"), F.col("l_orderkey").cast("string").alias("cell_id"))
             .agg(F.sum("l_quantity").alias("value")))


def cells_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("cell_id"), F.col("lang").alias("cluster"),
                    F.col("source").alias("ident"))


def counts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, cell_id, value): counts of every word (between ASCII blanks) of the whole text.

    The texts of a doc_id, usually one, are brought together on ``cell_id``, by which the join
    with the cells deals as well. A word's count is the length of its run among the cell's
    sorted words, so that memory is bounded by a cell and no word is shuffled or hashed.
    """
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    texts = d.groupBy(F.col("doc_id").cast("string").alias("cell_id")).agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    words = texts.select("cell_id", F.sort_array(F.split("text", r"[\x20\x09-\x0D]+")).alias("words"))
    n = F.size("words")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("words", i) != F.get("words", i - 1)))
    # for an inner explode the optimizer adds a filter on the array's size, which works the runs out twice
    runs = words.select("cell_id", "words", ends.alias("ends")).select("*", F.posexplode_outer("ends").alias("run", "end"))
    return (runs.select(F.get("words", F.col("end") - 1).alias("gene"), "cell_id",
                        (F.col("end") - F.coalesce(F.get("ends", F.col("run") - 1), F.lit(0))).cast("double").alias("value"))
                .where(F.col("gene") != ""))


def demo_gene_sets_wide(spark: SparkSession) -> DataFrame:
    """The toy two-column gene-set table (string columns, NULL padding)."""
    n = max(len(DEMO_GENE_SET_1), len(DEMO_GENE_SET_2))
    rows = [(DEMO_GENE_SET_1[i] if i < len(DEMO_GENE_SET_1) else None,
             DEMO_GENE_SET_2[i] if i < len(DEMO_GENE_SET_2) else None) for i in range(n)]
    return spark.createDataFrame(rows, "gene1 string, gene2 string")


# DuckDB text of the same fixtures, used by the oracle SQL (plans/catalog.py).
def _case_sql(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {arms} ELSE '{values[-1]}' END"


SQL_UNITS_DENSE = f"""
SELECT vec_id, label,
  {_case_sql('label', HUMAN_FIXTURE_CLUSTERS)}
  || '_' || CASE WHEN vec_id % 5 = 0 THEN 'NA' WHEN vec_id % 2 = 0 THEN 'Responders' ELSE 'NonResponders' END
  || '_' || CASE vec_id % 3 WHEN 0 THEN 'BT' ELSE 'OT' END
  || '_S' || CAST(vec_id % 20 AS VARCHAR) || '_GC' || CAST(vec_id % 7 AS VARCHAR)
  || '_' || CAST(vec_id + 1 AS VARCHAR) AS unit
FROM embeddings"""

SQL_UNITS_MOUSE = f"""
SELECT vec_id, {_case_sql('label', MOUSE_FIXTURE_CELLTYPES)}
  || '_S' || CAST(vec_id % 20 AS VARCHAR) || '_' || CAST(vec_id + 1 AS VARCHAR) AS unit
FROM embeddings"""


def sql_expr_from(units_view: str) -> str:
    return f"""
SELECT u.unit, 'D' || lpad(CAST(e.i - 1 AS VARCHAR), 2, '0') AS gene, CAST(e.x AS DOUBLE) AS value
FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) e
JOIN {units_view} u ON e.vec_id = u.vec_id"""


SQL_CELLS_STAR = """
SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderpriority AS cluster,
  CASE o_custkey % 3 WHEN 0 THEN 'Responders' WHEN 1 THEN 'NonResponders' END AS response,
  CASE o_orderstatus WHEN 'F' THEN 'BT' WHEN 'O' THEN 'OT' END AS timepoint,
  'S' || CAST(o_custkey % 4 AS VARCHAR) AS ident, 'GC ' || CAST(o_custkey % 2 AS VARCHAR) AS patient
FROM orders"""

SQL_COUNTS_STAR = """
SELECT p_brand || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '' END || p_type AS gene,
  CAST(l_orderkey AS VARCHAR) AS cell_id, sum(l_quantity) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2"""

SQL_CELLS_TEXT = """
SELECT CAST(doc_id AS VARCHAR) AS cell_id, lang AS cluster, source AS ident FROM documents"""

SQL_COUNTS_TEXT = """
SELECT gene, CAST(doc_id AS VARCHAR) AS cell_id, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS gene FROM documents) t
GROUP BY gene, doc_id"""


def sql_demo_gene_sets_long() -> str:
    """(set_name, gene) rows of the toy sets, in DuckDB VALUES form."""
    rows = [("gene_sig_score_1", g) for g in DEMO_GENE_SET_1] + [("gene_sig_score_2", g) for g in DEMO_GENE_SET_2]
    vals = ", ".join(f"('{s}', '{g}')" for s, g in rows)
    return f"SELECT * FROM (VALUES {vals}) AS t(set_name, gene)"
