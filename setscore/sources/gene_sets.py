"""Gene-set tables.

A gene-set file is a delimited text table whose first two columns are two
gene sets of unequal length; further columns are ignored and column names do
not matter (sets are taken by position). Separator ``,`` ``;`` or tab; quote
none, ``"`` or ``'``; header on or off. Files may start with a UTF-8 BOM and
use CRLF line ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Positional names of the first two gene-set columns.
SIGNATURE_TABLE_NAMES = ("gene_signature_1", "gene_signature_2")
SCORE_SET_NAMES = ("gene_sig_score_1", "gene_sig_score_2")


def read_gene_sets(spark: SparkSession, path: str, sep: str = ",", quote: str = '"',
                   header: bool = True) -> DataFrame:
    """S3: the raw table, every column a string, blanks as NULL."""
    return (spark.read.option("sep", sep)
                 .option("quote", quote)          # "" turns quoting off
                 .option("header", str(header).lower())
                 .option("inferSchema", "false")
                 .option("encoding", "UTF-8")
                 .csv(path))


def first_two(df: DataFrame, names: Sequence[str] = SIGNATURE_TABLE_NAMES) -> DataFrame:
    """Keep the first two columns by position and rename them."""
    if len(df.columns) < 2:
        raise ValueError("a gene-set table needs at least two columns")
    a, b = df.columns[:2]
    return df.select(F.col(f"`{a}`").alias(names[0]), F.col(f"`{b}`").alias(names[1]))


def gene_set_table(df: DataFrame) -> DataFrame:
    """The table shown to the user, blanks kept."""
    return first_two(df, SIGNATURE_TABLE_NAMES)


def gene_sets_long(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide set columns -> (set_name, gene), NULL and empty genes removed, distinct."""
    cols = list(columns or wide.columns)
    long = wide.unpivot([], cols, "set_name", "gene")
    return (long.where(F.col("gene").isNotNull() & (F.col("gene") != ""))
                .select("set_name", "gene").distinct())


def score_sets(df: DataFrame) -> DataFrame:
    """The app's path: first two columns renamed gene_sig_score_1/2, then P13."""
    return gene_sets_long(first_two(df, SCORE_SET_NAMES))
