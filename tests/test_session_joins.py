"""Helpers behind the scale rules: checkpoint folder, partition counts."""

from setscore.operators.joins import work_partitions
from setscore.session import ensure_checkpoint_dir


def test_checkpoint_dir_is_kept_when_set(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert ensure_checkpoint_dir(spark) == (before or spark.conf.get("spark.checkpoint.dir"))
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")   # stable, never replaced


def test_work_partitions_not_below_shuffle_width(spark):
    assert work_partitions(spark.range(1)) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
