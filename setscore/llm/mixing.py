"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a seeded random order, ``MAX_EPOCHS`` times over. A document's
virtual finish time is the number of its source's words up to its end, divided by the source's
target; all are then sorted by it in ranges, and the mix is what comes before the total budget is
spent. So each source runs through its target at the same virtual pace.

Targets are found by water filling: by weight, but never above ``MAX_EPOCHS`` times a source's size.
Sources by code point, null last, weigh 5, 2, 1, repeating.

Prefix sums never gather a source: the random order is cut into buckets by its key, buckets' sums
(pre-aggregated) are added up per source, and only a bucket's rows are sorted together. Equal rows
(doc_id, source, text) are one row with a count until their start is known, so copies of a row can't
heat a bucket; then the row is cut into runs of at most ``RUN`` copies. The cut is found from the sums of the sorted ranges and the rows of one range.

The random key is of doc_id and text, so the rows of one doc_id spread over the buckets too.

Nulls: a null text has size 0; a null source is a source; null doc_ids are told apart by text. Documents of size 0 take nothing. An empty table gives an empty mix. Other
columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setscore.llm.common import SPACED_WORD, free_name, materialise, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5             # of all words
MAX_EPOCHS = 2
BUCKET_ROWS = 4_000     # rows sorted together within a source
RUN = 1_000             # copies that one row stands for once places are known
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, n, target) from (source, source_size, n), one row per source."""
    one = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "source_no")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("source_no", F.row_number().over(by_name))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("double"))
    s = s.withColumns({"cap": F.col("source_size") * float(MAX_EPOCHS), "budget": F.sum("source_size").over(one) * BUDGET})
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                       "w_left": F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
    # the first source, by cap over weight, that the level doesn't fill sets the level of the rest
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("open_level", F.min_by(F.when(~F.col("full"), F.col("level")),
                                            F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "source_no"))).over(one))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("open_level") * F.col("w"))
    return s.select("source", "source_no", "source_size", "n", target.alias("target"))


def finish_times(docs: DataFrame) -> DataFrame:
    """One row per run of copies of a (doc_id, source, text): copies, size, the source's numbers, and
    ``start``, the words of its source before it."""
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("text_hash"))
    rows = materialise(rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = materialise(source_targets(sizes), "mix-sources")
    own = sources.withColumnRenamed("source", "of")
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash")))
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / float(1 << 32)
    rows = rows.withColumn("key", key).withColumn("bucket", F.floor(part * F.ceil(F.col("n") / BUCKET_ROWS)))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_start"))
    inside = (Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(sums, ["source_no", "bucket"])
    start = F.col("bucket_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    rows = rows.withColumn("start", start).withColumn("done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    return materialise(rows.select("doc_id", "source", "text_hash", "size", F.least(F.lit(RUN), F.col("copies") - F.col("done")).cast("long").alias("copies"),
                                   "source_no", "source_size", "target", "key", (F.col("start") + F.col("size") * F.col("done")).alias("start")), "mix-order")


def _finish(copy: Column, epoch: Column | int) -> Column:
    """Virtual finish time of a row's copy (from 1) in an epoch (from 0)."""
    done = F.col("source_size") * epoch + F.col("start") + F.col("size") * copy
    return F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))


def cut_time(rows: DataFrame) -> float | None:
    """The finish time of the first document that doesn't fit the budget (None: all fit)."""
    each = (rows.where(F.col("size") > 0)
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
                .withColumn("epoch", F.explode(F.array(*map(F.lit, range(MAX_EPOCHS)))))
                .select(_finish(F.col("copy"), F.col("epoch")).alias("time"), "source_no", "key", "size"))
    ranges = materialise(each.repartitionByRange("time", "source_no", "key").withColumn("part", F.spark_partition_id()), "mix-ranges")
    sums = ranges.groupBy("part").agg(F.sum("size").alias("words"))
    # one row per range
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(
        Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = (rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0) * BUDGET
    crossing = sums.where(F.col("before") + F.col("words") > budget).orderBy("part").select("part", "before").first()
    if crossing is None:
        return None
    own = Window.partitionBy("part").orderBy("time", "source_no", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranges.where(F.col("part") == crossing.part).withColumn("used", F.sum("size").over(own) + crossing.before)
                  .where(F.col("used") > budget).agg(F.min("time")).first()[0])


def _in_mix(copy: Column, cut: float | None) -> Column:
    """How often a copy of a row comes before the cut."""
    times = F.lit(0)
    for epoch in range(MAX_EPOCHS):
        times = times + (F.lit(True) if cut is None else _finish(copy, epoch) < cut).cast("int")
    return times


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: its source's numbers and how often the mix takes it."""
    rows = finish_times(docs)
    cut = cut_time(rows)
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "source", "size", "source_size", "target", _in_mix(F.col("copy"), cut).alias("times"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them. Rows equal in doc_id, source and
    text come from one of them."""
    rows = finish_times(docs)
    cut = cut_time(rows)
    times = F.aggregate(F.sequence(F.lit(1).cast("long"), "copies"), F.lit(0), lambda n, c: n + _in_mix(c, cut))
    plan = rows.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_hash").alias("p_hash"), times.alias("times")).where("times > 0")
    row, h = free_name(docs, "row"), free_name(docs, "hash")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = (docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.md5("text"), F.lit("")).alias(h), every.alias(row))
               .groupBy("doc_id", "source", h).agg(F.first(row).alias(row)))
    joined = one.join(plan, F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source"))
                      & (F.col(h) == F.col("p_hash")))
    return joined.select(row, F.explode(F.sequence(F.lit(1), "times")).alias("_time")).select(f"{row}.*")


def op10_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


QUERIES = {"op10_fair_queueing": op10_fair_queueing}

ORACLE_SQL = {"op10_fair_queueing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}'))::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM s0),
s2 AS (SELECT *, [5.0, 2.0, 1.0][(no - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
              sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT source, no, source_size, CASE WHEN cap <= level * w THEN cap
              ELSE w * (SELECT x.level FROM s3 x WHERE x.cap > x.level * x.w ORDER BY x.cap / x.w, x.no LIMIT 1) END AS target, budget FROM s3),
o AS (SELECT d.doc_id, d.size, d.key, s4.*, sum(d.size) OVER (PARTITION BY s4.no ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
e AS (SELECT *, CASE WHEN target > 0 THEN (epoch * source_size + cum) / target::DOUBLE ELSE 0 END AS time FROM o, (VALUES (0), (1)) AS epochs(epoch)),
g AS (SELECT time, sum(size) OVER (ORDER BY time, no, key ROWS UNBOUNDED PRECEDING) > budget AS late FROM e WHERE size > 0),
c AS (SELECT coalesce(min(time) FILTER (late), 'inf'::DOUBLE) AS cut FROM g)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (time < (SELECT cut FROM c)))::BIGINT AS taken
FROM e GROUP BY doc_id, size, source_size, target"""}
