"""Join helpers.

No join here carries a broadcast hint: adaptive execution broadcasts a side
whose measured size is below the session's threshold and shuffles both else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_partitions(df: DataFrame, factor: int = 4) -> int:
    """Partition count for compute-heavy, byte-light stages.

    AQE sizes partitions by bytes; a small table that feeds O(n^2) work would
    collapse into one task. Such stages repartition explicitly to a multiple
    of the cluster's parallelism instead.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # no SparkContext handle: fall back to the shuffle width
        cores = 0
    return max(shuffle, cores * factor)


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (R keeps NA as a group key)."""
    keys = list(keys)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
