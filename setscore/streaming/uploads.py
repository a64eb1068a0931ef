"""Upload-triggered scoring (the interactive report loop) as Structured Streaming.

The reference rescores whenever a user uploads a gene-set file. Here every
file that lands in ``upload_dir`` is one upload: a file-source stream reads it
with the same CSV options as :func:`setscore.sources.gene_sets.read_gene_sets`
(first two columns by position, further columns ignored), and ``foreachBatch``
runs the random walk of the batch's sets over gene ranks computed once.
Each batch writes its scores to ``<output_dir>/batch_id=<n>`` in overwrite
mode, so a retried batch replaces its own output (idempotent). The stream's
progress lives under the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscore.operators.scoring import rank_matrix, walk_scores
from setscore.session import cut_lineage, ensure_checkpoint_dir
from setscore.sources.gene_sets import SCORE_SET_NAMES

_UPLOAD_SCHEMA = "c1 string, c2 string"


def upload_stream(spark: SparkSession, upload_dir: str, sep: str = ",", quote: str = '"',
                  header: bool = True) -> DataFrame:
    """Streaming (upload, set_name, gene) rows, one upload per arriving file."""
    raw = (spark.readStream.schema(_UPLOAD_SCHEMA)
                .option("sep", sep).option("quote", quote).option("header", str(header).lower())
                .option("mode", "PERMISSIVE")
                .csv(upload_dir)
                .withColumn("upload", F.input_file_name()))
    long = raw.unpivot(["upload"], ["c1", "c2"], "col", "gene")
    set_name = F.when(F.col("col") == "c1", F.lit(SCORE_SET_NAMES[0])).otherwise(F.lit(SCORE_SET_NAMES[1]))
    return long.where(F.col("gene").isNotNull() & (F.col("gene") != "")).select("upload", set_name.alias("set_name"),
                                                                                "gene")


def score_uploads(spark: SparkSession, expr: DataFrame, upload_dir: str, output_dir: str,
                  sep: str = ",", quote: str = '"', header: bool = True, query_name: str = "uploads"):
    """Start the stream; returns the StreamingQuery.

    The kernel CDF and gene ranks do not depend on the gene sets, so they are
    computed once here and checkpointed; each upload then costs only the
    hits-only walk. The stream's progress is kept under
    ``<spark.checkpoint.dir>/streams/<query_name>``: restarting with the same
    name resumes and skips uploads already scored.
    """
    ranked = cut_lineage(rank_matrix(expr))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        # one set per (upload, column): the upload path is part of the set key
        sets = (batch.select(F.concat_ws("\u0001", "upload", "set_name").alias("set_name"), "gene")
                     .distinct())
        scores = walk_scores(ranked, sets)
        parts = F.split(F.col("set_name"), "\u0001")
        out = scores.select(parts[0].alias("upload"), parts[1].alias("set_name"), "unit", "score")
        out.write.mode("overwrite").parquet(os.path.join(output_dir, f"batch_id={batch_id}"))

    checkpoint = os.path.join(ensure_checkpoint_dir(spark), "streams", query_name)
    return (upload_stream(spark, upload_dir, sep, quote, header).writeStream
            .foreachBatch(score_batch)
            .option("checkpointLocation", checkpoint)
            .queryName(query_name)
            .trigger(availableNow=True)
            .start())
