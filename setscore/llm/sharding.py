"""Sharding by a two-pass external shuffle.

Pass one gives every record its shard and scatters a shard's records uniformly, by seeded hashes,
into as many memory-sized buckets as its measured bytes need, and writes them to the shared folder.
Pass two brings one bucket at a time together, shuffles it (Spark's ``shuffle`` is Fisher and
Yates') and numbers its records from where the shard's earlier buckets end.

The law is ``key``: doc_id and the number of shards decide. A record goes to the shard whose hash
with its doc_id is largest, so one more shard takes records only into itself.

Only DataFrame functions are used. A hot doc_id fills its shard, as the law asks, but its records
are scattered over more buckets by their place in the scan, so no task grows. Buckets are
partitions of a fixed number and are sorted before they are shuffled: a task that is run again, and
a rerun over the same files and settings, gives the same order.

Nulls: a null text has size 16 and checksum 0; null doc_ids go to one shard together. Repeated rows
are records of their own. An empty table has no shards. Other columns travel along; where they clash
with a column of the result, the result's stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setscore.llm.common import materialise, table

SHARDS = 40
BUCKET_BYTES = 16 << 20     # of records that one task shuffles in memory
SEED = 20_231
OVERHEAD = 16               # bytes that a record counts besides its text


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, of 0 to shards - 1, whose hash with the key is largest."""
    rated = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(rated)["s"]


def scatter(docs: DataFrame, shards: int, bucket_bytes: int, seed: int) -> tuple[DataFrame, int]:
    """Pass one: (shard, bucket, place, size, record), written to the shared folder; number of buckets."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    # one row per shard
    heavy = {r.shard: r.bytes for r in docs.select(key_shard(F.col("doc_id"), shards, seed).alias("shard"), size.alias("size"))
             .groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, -(-heavy.get(s, 0) // bucket_bytes)) for s in range(shards)]
    place = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), size.alias("size"),
                        key_shard(F.col("doc_id"), shards, seed).alias("shard"), F.monotonically_increasing_id().alias("place"))
    n = F.element_at(F.array(*map(F.lit, buckets)), F.col("shard") + 1)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "place"), n).cast("int")
    return materialise(place.withColumn("bucket", bucket), "scatter"), sum(buckets)


def shuffled(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """(record, size, shard, slot): every record of ``docs`` with its place in its shard."""
    spread, n = scatter(docs, shards, bucket_bytes, seed)
    counts = spread.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    gathered = (spread.repartition(n, "shard", "bucket").groupBy("shard", "bucket")
                      .agg(F.array_sort(F.collect_list(F.struct("place", "size", "record")),
                                        lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1)).alias("records"))
                      .sortWithinPartitions("shard", "bucket")
                      .select("shard", "bucket", F.shuffle("records", seed).alias("records")))
    placed = gathered.join(first, ["shard", "bucket"]).select("shard", "first", F.posexplode("records").alias("pos", "r"))
    return placed.select("r.record", "r.size", "shard", (F.col("first") + F.col("pos")).alias("slot"))


def flat(shuffled_rows: DataFrame) -> DataFrame:
    """The records' columns, shard and slot. Columns of a record that are called shard or slot (any case) give way."""
    own = [F.col("record").getField(c).alias(c) for c in shuffled_rows.schema["record"].dataType.fieldNames() if c.lower() not in ("shard", "slot")]
    return shuffled_rows.select(*own, "shard", "slot")


def write_shards(docs: DataFrame, path: str, **kw) -> None:
    """Shards as Parquet folders ``shard=N`` below ``path``, the records in their slots' order."""
    flat(shuffled(docs, **kw)).write.partitionBy("shard").parquet(path)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shuffled(table(spark, sf_dir, "documents"))
    doc_id = F.col("record.doc_id")
    return s.select(doc_id.alias("doc_id"), "size", F.crc32(F.coalesce("record.text", F.lit(""))).alias("text_crc32"),
                    F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("int").alias("slot"),
                    key_shard(doc_id, SHARDS + 1).cast("int").alias("grown_shard"))


QUERIES = {"op7_external_shuffle": op7_external_shuffle}
