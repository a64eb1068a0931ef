"""Near-duplicates by SimHash, compared in bit slices.

Fingerprints have 64 bits from XXH64 of 3-word shingles. Only different fingerprints are compared.
Candidates share two of four 16-bit blocks: fingerprints within a radius of two differ in two
blocks at most. Each of the six pairs of blocks is a table; its keys are dealt over the tasks.
A task holds its fingerprints sorted by key and compares neighbours at distance 1, 2, ... in the
sorted order while they share a key. The differing bits of many pairs are stored as vertical bit
planes, one bit per pair, and added up with carry-save counters 64 pairs to a machine word; a block of pairs is
abandoned once all have passed the radius. Only links come out, and at radius two a fingerprint
has at most 2,080 of them.

The fingerprints of a key that holds more than ``SPLIT`` are dealt again: two within the radius agree
in six of eight 8-bit parts, so these go on in the 28 finer tables of six parts each, over all tasks.
Nothing is capped, and a finer key can't hold more than 65,536 different fingerprints.

Components follow from the links by alternating large-star and small-star rounds, each written to the
shared folder; links between different fingerprints only, so exact copies never make links.

Nulls: a null text is empty, with fingerprint zero. Null doc_ids have a class like any other; its
number is the smallest doc_id in it, null if there is none. Repeated rows share their class. Empty
tables give empty results. Other columns don't take part, or pass through where rows are kept.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import append_column, bytes_of, free_name, materialise, table

SHINGLE = 3
RADIUS = 2
SEED = 42
SPLIT = 2_000                # fingerprints of one key that a task compares without dealing them again
PAIRS = 1 << 16              # pairs compared at a time
# (first bit, bits) of the parts of a key: all but RADIUS of the parts agree
COARSE = list(combinations([(k, 16) for k in range(0, 64, 16)], 4 - RADIUS))
FINE = list(combinations([(k, 8) for k in range(0, 64, 8)], 8 - RADIUS))


def fingerprint(text: bytes) -> int:
    """The signed 64-bit fingerprint of UTF-8 text."""
    words = text.lower().split()             # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    k = min(SHINGLE, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)),
                         dtype="<u8", count=len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of its text as the long column ``name``."""
    return append_column(docs, name, T.LongType(), "text",
                         lambda column: pa.array([fingerprint(t) for t in bytes_of(column)], type=pa.int64()))


def within_radius(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) differ in at most ``radius`` bits, by bit planes and carry-save counters."""
    n = len(a)
    diff = np.zeros(-(-n // 64) * 64, dtype="<u8")
    diff[:n] = a ^ b
    # plane p, word w: bit p of pairs 64 w to 64 w + 63
    bits = np.unpackbits(diff.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
    counters = [np.zeros(planes.shape[1], dtype="<u8") for _ in range((radius + 1).bit_length())]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = np.zeros(planes.shape[1], dtype="<u8")
    for k, plane in enumerate(planes):
        carry = plane
        for c, counter in enumerate(counters):
            counters[c], carry = counter ^ carry, counter & carry
        over |= carry
        # radius + 1 in the counters is over; it stays so
        over |= reduce(np.bitwise_and, [counters[c] if (radius + 1) >> c & 1 else ~counters[c] for c in range(len(counters))])
        if k % 8 == 7 and (over == full).all():
            return np.zeros(n, dtype=bool)
    return ~np.unpackbits(over.view(np.uint8), bitorder="little")[:n].astype(bool)


def links_of(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within ``radius`` that share a key."""
    by = np.lexsort((prints, keys))
    keys, prints = keys[by], prints[by]
    left, right = [], []
    at = np.arange(len(keys))
    step = 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        for k in range(0, len(at), PAIRS):
            i = at[k:k + PAIRS]
            i = i[within_radius(prints[i], prints[i + step], radius)]
            left.append(prints[i])
            right.append(prints[i + step])
        step += 1
    none = np.zeros(0, dtype="<u8")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(keyed: DataFrame) -> DataFrame:
    """(a, b) links of (key, fp) rows; the rows of a key lie in one partition."""
    def run(batches):
        keys, prints = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            prints.append(batch.column(1).to_numpy().view("<u8"))
        if keys:
            a, b = links_of(np.concatenate(keys), np.concatenate(prints), RADIUS)
            for k in range(0, len(a), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + PAIRS].view("<i8")) for x in (a, b)], names=["a", "b"])
    return keyed.select("key", "fp").mapInArrow(run, "a long, b long")


def _slice(start: int, width: int):
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))


def _keyed(prints: DataFrame, tables: list) -> DataFrame:
    """(key, fp) rows: per table, a hash of its number and the bits of its parts."""
    keys = F.array(*[F.xxhash64(F.lit(len(parts)), F.lit(k), *[_slice(*part) for part in parts]) for k, parts in enumerate(tables)])
    return prints.select(F.explode(keys).alias("key"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of different fingerprints of ``prints(fp)`` within the radius, possibly repeated."""
    coarse = materialise(_keyed(prints, COARSE), "simhash-keys")
    # the few keys that one task shouldn't compare alone
    heavy = coarse.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("key")
    heavy = materialise(heavy, "simhash-heavy")
    light = coarse.join(heavy, "key", "left_anti")
    again = coarse.join(heavy, "key", "left_semi").select("fp").distinct()
    return _compare(light.repartition("key")).unionByName(_compare(_keyed(again, FINE).repartition("key")))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint (signed) of the component, for each one that has a link."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-links")
    before = None
    while True:
        # large star: every larger neighbour is linked to the smallest around
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours are linked to the smallest of them
        large = materialise(large, "simhash-star")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        edges = materialise(small, "simhash-star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"),
                        F.sum(F.col("b").cast("decimal(38,0)")).alias("sb"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash, component_id, component) per document; ``component`` is the class's own
    key, the smallest fingerprint in it."""
    fp = free_name(docs, "fp")
    rows = with_fingerprint(docs.select("doc_id", "text"), fp).select("doc_id", F.col(fp).alias("fp"), F.xxhash64("text").alias("text_hash"))
    rows = materialise(rows, "simhash-prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(prints.select("fp")))
    rooted = prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("component"))
    ids = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    rooted = materialise(rooted.join(ids, "component").select("fp", "component", "component_id"), "simhash-roots")
    return rows.join(rooted, "fp")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class: of its smallest doc_id (nulls last); of rows that tie there, one."""
    found = materialise(classes(docs), "simhash-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    keep = found.groupBy("component").agg(best.alias("k")).select(_row_key(F.col("k.doc_id"), F.col("k.text_hash")).alias("k"))
    k = free_name(docs, "row_key")
    keyed = docs.withColumn(k, _row_key(F.col("doc_id"), F.xxhash64("text")))
    # the join's partitioning and order serve the removal of repeated rows too
    return keyed.join(keep, keyed[k] == keep["k"], "left_semi").dropDuplicates([k]).drop(k)


def _row_key(doc_id, text_hash):
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.hex(text_hash))


def op9_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_bit_sliced_simhash": op9_bit_sliced_simhash}
