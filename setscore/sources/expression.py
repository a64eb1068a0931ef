"""Expression matrices and cell tables.

The long form ``(unit, gene, value)`` is the working representation. A wide
matrix (``gene`` plus one numeric column per unit) is unpivoted on read and
only pivoted back at the edge.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.operators.ranks import value_positions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS_SCHEMA = T.StructType([
    T.StructField("gene", T.StringType()),
    T.StructField("cell_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def wide_to_long(wide: DataFrame, gene_col: str = "gene") -> DataFrame:
    """Gene x unit matrix -> (unit, gene, value)."""
    units = [c for c in wide.columns if c != gene_col]
    long = wide.unpivot([gene_col], units, "unit", "value")
    return long.select("unit", F.col(gene_col).alias("gene"), F.col("value").cast("double").alias("value"))


def read_expression(spark: SparkSession, path: str, wide: bool = False, gene_col: str = "gene") -> DataFrame:
    """A pseudobulk matrix as (unit, gene, value)."""
    df = spark.read.parquet(path)
    if wide:
        return wide_to_long(df, gene_col)
    return df.select("unit", "gene", F.col("value").cast("double"))


def read_cells(spark: SparkSession, counts_path: str, cells_path: str) -> tuple[DataFrame, DataFrame]:
    """Sparse counts (gene, cell_id, value) and the cell metadata table."""
    counts = spark.read.schema(COUNTS_SCHEMA).parquet(counts_path)
    cells = spark.read.parquet(cells_path)
    return counts, cells


def write_cell_layout(counts: DataFrame, cells: DataFrame, path: str, buckets: int) -> None:
    """Storage layout for J1: counts and cells bucketed and sorted by ``cell_id`` into the same number of
    buckets below ``path``, one file a bucket, so that their join needs no exchange of the counts.

    ``buckets`` is fixed when the layout is written: about the bytes of the counts over the bytes that
    one task should read. A cell has at most one count per gene, so no bucket is hot.
    """
    spark = counts.sparkSession
    for kind, df in (("counts", counts.select("gene", "cell_id", "value")), ("cells", cells)):
        # Spark deals partitions and buckets by the same hash, so every task writes one bucket
        name = f"{_layout_name(path)}_{kind}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (df.repartition(buckets, "cell_id").write.bucketBy(buckets, "cell_id").sortBy("cell_id")
           .format("parquet").mode("overwrite").option("path", f"{path}/{kind}").saveAsTable(name))
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def read_cell_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(counts, cells) of a layout that any session wrote; the session's catalog gets a table of each."""
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    out = []
    for kind in ("counts", "cells"):
        name = f"{_layout_name(path)}_{kind}"
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{kind}").schema)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell_id) SORTED BY (cell_id) "
                      f"INTO {buckets} BUCKETS LOCATION '{path}/{kind}'")
        out.append(spark.table(name))
    return out[0], out[1]


def _layout_name(path: str) -> str:
    return "cell_layout_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def write_pseudobulk(df: DataFrame, path: str, units: Sequence[str] | None = None) -> None:
    """The pseudobulk as parquet that :func:`read_expression` reads back.

    Long: (unit, gene, value, cell_count), the means above zero. With ``units``: one column
    for each, absent means 0.
    """
    long = df.withColumnRenamed("mean_exp", "value")
    if units is not None:
        from setscore.operators.reshape import long_to_wide
        long = long_to_wide(long, "gene", "unit", "value", units)
    long.write.mode("overwrite").parquet(path)


# ---- wide matrices with an open set of units ----------------------------------------------------

def _scatter(block_units: int):
    def run(batches):
        for batch in batches:
            cells = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            dense = np.zeros((batch.num_rows, block_units))
            dense[rows, flat.field("slot").to_numpy()] = flat.field("value").to_numpy(zero_copy_only=False)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * block_units)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(dense.reshape(-1)))],
                                             names=["gene", "block", "values"])
    return run


def write_matrix(long: DataFrame, path: str, block_units: int = 1024) -> None:
    """S5 for any number of units: ``long`` (unit, gene, value) as a dense matrix in blocks of columns.

    ``units`` gives every unit its block and slot; ``blocks/block=N`` has a row per gene with the
    values of the block's slots, 0 where there is none. No list of units passes through the driver,
    and a row is at most a block wide. (unit, gene) must be unique; NULL values are written as 0.
    """
    place = value_positions(long.select("unit").distinct(), [], "unit").select(
        F.col("unit").alias("of"), F.floor(F.col("before") / block_units).cast("int").alias("block"), (F.col("before") % block_units).cast("int").alias("slot"))
    place.withColumnRenamed("of", "unit").write.mode("overwrite").parquet(f"{path}/units")
    place = long.sparkSession.read.parquet(f"{path}/units").withColumnRenamed("unit", "of")
    cells = long.join(place, F.col("unit") == F.col("of")).groupBy("gene", "block").agg(
        F.collect_list(F.struct("slot", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))).alias("cells"))
    dense = cells.mapInArrow(_scatter(block_units), "gene string, block int, values array<double>")
    dense.repartition("block").sortWithinPartitions("block", "gene").write.mode("overwrite").partitionBy("block").parquet(f"{path}/blocks")


def read_matrix(spark: SparkSession, path: str, zeros: bool = False) -> DataFrame:
    """A matrix of :func:`write_matrix` as (unit, gene, value); without ``zeros`` the non-zero values."""
    rows = spark.read.schema("gene string, values array<double>, block int").parquet(f"{path}/blocks")
    cells = rows.select("gene", F.col("block").alias("of"), F.posexplode("values").alias("at", "value"))
    cells = cells if zeros else cells.where(F.col("value") != 0)
    units = spark.read.parquet(f"{path}/units")
    return cells.join(units, (F.col("of") == F.col("block")) & (F.col("at") == F.col("slot"))).select("unit", "gene", "value")


def read_matrix_block(spark: SparkSession, path: str, block: int) -> DataFrame:
    """One block as a wide table: gene and a column for each of its units, of which there are at most a block's."""
    names = spark.read.parquet(f"{path}/units").where(F.col("block") == block).orderBy("slot").collect()
    rows = spark.read.schema("gene string, values array<double>, block int").parquet(f"{path}/blocks").where(F.col("block") == block)
    return rows.select("gene", *[F.col("values")[r.slot].alias(r.unit) for r in names])
