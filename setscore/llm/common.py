"""Helpers shared by the operators: staging, column appending in Arrow tasks, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from setscore.session import ensure_checkpoint_dir

# The two word patterns of the operators' contracts.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # on text with A-Z lower-cased
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, removed when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/setscore-llm/{kind}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: one computation, short
    lineage, column pruning for later readers, and no loss when an executor goes."""
    spark = df.sparkSession
    path = shared_folder(spark, kind) + "/data"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that no column of ``df`` has (any case)."""
    taken = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def append_column(df: DataFrame, name: str, kind: T.DataType, text_col: str,
                  fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with one more column: ``fn`` of each Arrow batch's texts. Spark bounds a batch in
    rows and bytes. ``name`` must be free in ``df``; the other columns pass through untouched."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = fn(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as ''."""
    return pc.fill_null(column, "").to_pylist()


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as b''."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def alnum_bytes() -> np.ndarray:
    """Which byte values belong to a word of ALNUM_WORD once A-Z are lower-cased."""
    ok = np.zeros(256, dtype=bool)
    ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = ok[0x80:] = True
    return ok


_PIECE = 1 << 21                       # bytes hashed at a time: bounds the temporaries
_BASE = 0x9E3779B97F4A7C15             # odd, so it has an inverse modulo 2^64


class WordHasher:
    """64-bit hashes of the words of UTF-8 bytes with A-Z lower-cased, computed by prefix sums of
    byte * base^position; the words' strings are never built."""

    def __init__(self, is_word: np.ndarray):
        self.is_word = is_word
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[0x41:0x5B] += 32
        self.lower += np.uint64(1)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            def powers(base: int) -> np.ndarray:
                a = np.full(n, base, dtype=np.uint64)
                a[0] = 1
                return np.cumprod(a)
            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def pieces(self, data: bytes):
        """(offset, end) ranges of about _PIECE bytes that end beside a word."""
        at = 0
        while at < len(data):
            end = min(len(data), at + _PIECE)
            while end < len(data) and self.is_word[data[end]]:
                end += 1
            yield at, end
            at = end

    def spans(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each given span's bytes, A-Z lower-cased."""
        size = end - start
        raw = np.frombuffer(data, dtype=np.uint8)
        first = np.cumsum(size) - size
        byte = raw[np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(start, size)]
        self._powers(int(size.max(initial=0)) + 1)
        place = np.arange(len(byte)) - np.repeat(first, size)
        return np.add.reduceat(self.lower[byte] * self.up[place], first) if len(size) else np.zeros(0, np.uint64)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte) of every word of ``data``, in order."""
        hashes, starts, ends = [], [], []
        for at, end in self.pieces(data):
            raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
            edge = np.diff(self.is_word[raw].astype(np.int8), prepend=0, append=0)
            s, e = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            self._powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(self.lower[raw] * self.up[:len(raw)], out=total[1:])
            h = (total[e] - total[s]) * self.down[s]
            h ^= (e - s).astype(np.uint64)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
