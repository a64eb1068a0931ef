"""Merkle manifest of a dataset, leaves placed by bitmap ranks.

Every row is a leaf; a source's leaves ascend by doc_id. Their places come from bitmaps, not from a
sort: each source's doc_ids are merged into 64-bit words with a bitwise-or that every task begins for
its own rows (words without ids aren't stored), and a popcount directory over them gives the rows before
each word. The directory has one level for every 16 bits of the word's number, so each of its windows
counts at most 65,536 entries, whatever the source holds. A row's place is the directory's count and the
popcount of the lower bits of its word.

Where a word has more rows than bits, doc_ids are repeated: its rows are counted by doc_id and leaf,
and get their places from directories over the doc_ids and the first 16 bits of the leaves. Equal rows
stay counted until their places are dealt out in runs.

Places group the leaves: ``FAN`` to the power of ``LEVELS`` neighbours are a block, one array keyed by
slot, which a task reduces by that many levels at once. The blocks' tops go on in the same way, source
by source, until one is left; the subroots are placed by a range sort and reduced likewise. Going down
again, each block adds the siblings inside it to those above. No list of leaves, sources or nodes is held.

Nulls: a null source is a source of its own and comes first; a null doc_id comes first in its source
and isn't tampered with. Rows of equal source and doc_id follow one another by leaf; repeated rows are
leaves of their own. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import materialise, table

FAN = 3
LEVELS = 6                   # levels that a block reduces: 729 slots
BLOCK = FAN ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 1_000                  # copies of a row dealt out together
DIGIT = 16                   # bits of a directory level
WORD_BITS = 58               # of a word's number: 64 less the 6 within it
ROWS = 2_048                 # rows of an Arrow batch that a task gives out

_NULL_WORD = -(1 << (WORD_BITS - 1)) - 1     # before the words of all doc_ids


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each '-' if null, else its UTF-8 byte count, ':' and its value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(skey, doc_id, word, bit, leaf, tampered): skey is the source, null as '' and others after '='."""
    fields = {c: F.col(c) for c in FIELDS}
    doc_id, text = F.col("doc_id").cast("long"), F.col("text")
    changed = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    changed = changed & (F.instr(text, "\n") > 0)
    other = leaf_of(list({**fields, "text": F.translate(text, "\n", "")}.values()))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"), doc_id.alias("doc_id"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(_NULL_WORD)).alias("word"), F.coalesce(doc_id.bitwiseAND(63), F.lit(0)).cast("int").alias("bit"),
        F.unhex(leaf_of(list(fields.values()))).alias("leaf"), F.when(changed, F.unhex(other)).alias("tampered"))


def _before(window) -> Column:
    """Rows counted before this one in the window."""
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def directory(counts: DataFrame, bits: int = WORD_BITS) -> DataFrame:
    """(skey, word, start) from (skey, word, n): the rows of the source in smaller words."""
    if bits <= DIGIT:
        return counts.select("skey", "word", _before(Window.partitionBy("skey").orderBy("word")).alias("start"))
    above = F.shiftright("word", DIGIT)
    sums = counts.groupBy("skey", above.alias("word")).agg(F.sum("n").alias("n"))
    up = directory(sums, bits - DIGIT).select(F.col("skey").alias("up_key"), F.col("word").alias("up_word"), F.col("start").alias("up_start"))
    own = counts.withColumns({"above": above, "here": _before(Window.partitionBy("skey", above).orderBy("word"))})
    own = own.join(up, (F.col("skey") == F.col("up_key")) & (F.col("above") == F.col("up_word")))
    return own.select("skey", "word", (F.col("here") + F.col("up_start")).alias("start"))


def _repeated(rows: DataFrame) -> DataFrame:
    """(skey, doc_id, leaf, tampered, place) of rows in words with repeated doc_ids; their ``start`` is the word's."""
    same = rows.groupBy("skey", "word", "bit", "start", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))
    same = materialise(same.withColumn("prefix", F.substring(F.hex("leaf"), 1, 4)), "merkle-repeated")
    key = ["skey", "word", "bit"]
    ids = same.groupBy(*key).agg(F.sum("n").alias("n"))
    ids = ids.select(*key, _before(Window.partitionBy("skey", "word").orderBy("bit")).alias("id_start"))
    some = same.groupBy(*key, "prefix").agg(F.sum("n").alias("n"))
    some = some.select(*key, "prefix", _before(Window.partitionBy(*key).orderBy("prefix")).alias("prefix_start"))
    here = same.withColumn("leaf_start", _before(Window.partitionBy(*key, "prefix").orderBy("leaf")))
    here = here.join(some, [*key, "prefix"]).join(ids, key)
    first = F.col("start") + F.col("id_start") + F.col("prefix_start") + F.col("leaf_start")
    # copies in runs, so that no row's list of places is long
    long_0 = F.lit(0).cast("long")
    runs = here.select("skey", "doc_id", "leaf", "tampered", "n", first.alias("first"),
                       F.explode(F.sequence(long_0, F.col("n") - 1, F.lit(RUN).cast("long"))).alias("run"))
    copies = F.sequence(long_0, F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run")) - 1)
    return (runs.select("skey", "doc_id", "leaf", "tampered", "first", "run", F.explode(copies).alias("copy"))
                .select("skey", "doc_id", "leaf", "tampered", (F.col("first") + F.col("run") + F.col("copy")).alias("place")))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skey, doc_id, leaf, tampered, place) of every row, and (skey, n) of every source."""
    rows = materialise(leaves(docs), "merkle-leaves")
    one = F.expr("shiftleft(1L, bit)")
    words = rows.groupBy("skey", "word").agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("n"))
    words = materialise(words, "merkle-words")
    found = words.join(directory(words).withColumnsRenamed({"skey": "d_key", "word": "d_word"}),
                       (F.col("skey") == F.col("d_key")) & (F.col("word") == F.col("d_word")))
    found = found.select(F.col("skey").alias("w_key"), F.col("word").alias("w_word"), "bits", "start",
                         (F.bit_count("bits") < F.col("n")).alias("repeats"))
    joined = rows.join(materialise(found, "merkle-directory"), (F.col("skey") == F.col("w_key")) & (F.col("word") == F.col("w_word")))
    lower = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    plain = joined.where("NOT repeats").select("skey", "doc_id", "leaf", "tampered", (F.col("start") + lower).alias("place"))
    return plain.unionByName(_repeated(joined.where("repeats"))), words.groupBy("skey").agg(F.sum("n").alias("n"))


# ---- blocks -------------------------------------------------------------

def reduce_slots(slots: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block from its slots up: until one node is left, or, unless the block is all
    there is, for LEVELS levels."""
    levels = [slots]
    while len(levels[-1]) > 1 if whole else len(levels) <= LEVELS:
        now = levels[-1]
        levels.append([digest("".join(now[k:k + FAN])) for k in range(0, len(now), FAN)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """Per level, the nodes of the slot's run to its left and to its right, joined."""
    out = []
    for now in levels[:-1]:
        first = slot // FAN * FAN
        out.append(("".join(now[first:slot]), "".join(now[slot + 1:first + FAN])))
        slot //= FAN
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _pairs(path) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def blocks(items: DataFrame, sizes: DataFrame, extra: list[str], kind: str) -> DataFrame:
    """(skey, block, whole, slots, top): items (skey, place, node, *extra) in blocks keyed by slot. A
    block is whole if its source, of ``sizes`` (skey, n), has no other."""
    slot = F.struct((F.col("place") % BLOCK).cast("int").alias("slot"), F.col("node"), *extra)
    dealt = items.groupBy("skey", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.collect_list(slot).alias("slots"))
    n = sizes.select(F.col("skey").alias("n_key"), (F.col("n") <= BLOCK).alias("whole"))
    dealt = dealt.join(n, F.col("skey") == F.col("n_key")).select("skey", "block", "whole", "slots")

    def run(batches):
        for batch in batches:
            tops = [bytes.fromhex(reduce_slots(_nodes(slots), whole)[-1][0]) for whole, slots in
                    zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], names=[*batch.schema.names, "top"])

    schema = T.StructType([*dealt.schema.fields, T.StructField("top", T.BinaryType())])
    return materialise(dealt.mapInArrow(run, schema), kind)


def _nodes(slots: list[dict]) -> list[str]:
    """Hex digests of a block, each at its slot."""
    out = [""] * len(slots)
    for s in slots:
        out[s["slot"]] = s["node"].hex()
    return out


def climb(items: DataFrame, sizes: DataFrame, extra: list[str], kind: str) -> list[DataFrame]:
    """Tables of blocks from the items up; the whole blocks in them hold the sources' tops."""
    out = [blocks(items, sizes, extra, kind)]
    largest = sizes.agg(F.max("n")).first()[0] or 0
    while largest > BLOCK:
        sizes = sizes.where(F.col("n") > BLOCK).select("skey", F.ceil(F.col("n") / BLOCK).alias("n"))
        items = out[-1].where("NOT whole").select("skey", F.col("block").alias("place"), F.col("top").alias("node"))
        out.append(blocks(items, sizes, [], kind))
        largest = -(-largest // BLOCK)
    return out


def descend(tables: list[DataFrame], above: DataFrame, kind: str) -> DataFrame:
    """The lowest blocks with ``path``, the siblings above each. ``above`` (a_key, a_path) has those above every source's top."""
    def paths(batches):
        """(skey, place, path) of the items of blocks."""
        for batch in batches:
            out = []
            for key, block, whole, slots, path in zip(*(batch.column(c).to_pylist() for c in ("skey", "block", "whole", "slots", "path")), strict=True):
                levels = reduce_slots(_nodes(slots), whole)
                for k in range(len(slots)):
                    own = [{"left": a, "right": b} for a, b in siblings(levels, k)]
                    out.append({"skey": key, "place": block * BLOCK + k, "path": own + path})
                    if len(out) == ROWS:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("skey", pa.string()), ("place", pa.int64()), ("path", _PATH_TYPE)])
    below = None
    for k in range(len(tables) - 1, -1, -1):
        whole = tables[k].where("whole").join(above, F.col("skey") == F.col("a_key")).select(*tables[k].columns, F.col("a_path").alias("path"))
        if below is None:
            now = whole
        else:
            now = whole.unionByName(tables[k].where("NOT whole").join(below, (F.col("skey") == F.col("b_key")) & (F.col("block") == F.col("b_place")))
                                    .select(*tables[k].columns, F.col("b_path").alias("path")))
        if k == 0:
            return now
        below = materialise(now.mapInArrow(paths, f"skey string, place long, path {_PATH}"), kind).withColumnsRenamed(
            {"skey": "b_key", "place": "b_place", "path": "b_path"})


def positions(df: DataFrame, by: str, kind: str) -> DataFrame:
    """``df`` with ``place``: its rows' order by ``by``, from 0, over all ranges of a range sort."""
    ranges = materialise(df.repartitionByRange(by).withColumn("part", F.spark_partition_id()), kind)
    parts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per range
    parts = parts.select(F.col("part").alias("range_no"), _before(Window.partitionBy(F.lit(0)).orderBy("part")).alias("first"))
    here = ranges.withColumn("here", F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1)
    return here.join(parts, F.col("part") == F.col("range_no")).withColumn("place", F.col("first") + F.col("here")).drop("part", "range_no", "first", "here")


RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows, sizes = placed(docs)
    sizes = materialise(sizes, "merkle-sizes")
    lower = climb(rows.withColumnRenamed("leaf", "node"), sizes, ["doc_id", "tampered"], "merkle-blocks")

    tops = None
    for t in lower:
        top = t.where("whole").select(F.col("skey").alias("of"), "top")
        tops = top if tops is None else tops.unionByName(top)
    tops = materialise(positions(tops, "of", "merkle-sources"), "merkle-subroots")
    n = tops.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("skey"), "n").where("n > 0")
    upper = climb(tops.select(F.lit("").alias("skey"), "place", F.col("top").alias("node"), "of"), materialise(n, "merkle-sizes"), ["of"], "merkle-top")

    spark = docs.sparkSession
    root = upper[-1].where("whole").select(F.lower(F.hex("top")).alias("root")).first()
    if root is None:
        return spark.createDataFrame([], RESULT)
    root = root.root
    none = spark.createDataFrame([("", [])], f"a_key string, a_path {_PATH}")

    def source_paths(batches):
        schema = pa.schema([("a_key", pa.string()), ("subroot", pa.string()), ("a_path", _PATH_TYPE)])
        for batch in batches:
            out = []
            for whole, slots, path in zip(*(batch.column(c).to_pylist() for c in ("whole", "slots", "path")), strict=True):
                levels = reduce_slots(_nodes(slots), whole)
                for s in slots:
                    own = [{"left": a, "right": b} for a, b in siblings(levels, s["slot"])]
                    out.append({"a_key": s["of"], "subroot": s["node"].hex(), "a_path": own + path})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    above = materialise(descend(upper, none, "merkle-paths").mapInArrow(source_paths, f"a_key string, subroot string, a_path {_PATH}"), "merkle-above")
    found = descend(lower, above.select("a_key", "a_path"), "merkle-paths")
    found = found.join(above.select(F.col("a_key").alias("s_key"), "subroot"), F.col("skey") == F.col("s_key"))

    def proofs(batches):
        for batch in batches:
            out = []
            for whole, slots, path, subroot in zip(*(batch.column(c).to_pylist() for c in ("whole", "slots", "path", "subroot")), strict=True):
                levels = reduce_slots(_nodes(slots), whole)
                path = _pairs(path)
                for s in slots:
                    steps = siblings(levels, s["slot"]) + path
                    leaf = s["node"].hex()
                    back = folded(leaf if s["tampered"] is None else s["tampered"].hex(), steps)
                    out.append((s["doc_id"], leaf, subroot, root, digest("".join(a + b for a, b in steps)), back, back == root))
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return found.select("whole", "slots", "path", "subroot").mapInArrow(proofs, RESULT)


def op12_bitmap_rank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_bitmap_rank_manifest": op12_bitmap_rank_manifest}

# CRC-32, bit by bit (polynomial 0xEDB88320)
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


ORACLE_SQL = {"op12_bitmap_rank_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
      CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS other FROM documents),
p AS (SELECT *, coalesce('=' || source, '') AS sk, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
      count(*) OVER (PARTITION BY source) AS n FROM d),
low(sk, level, idx, h, n) AS (SELECT sk, 0, idx, leaf, n FROM p
      UNION ALL SELECT sk, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3)
      FROM low WHERE n > 1 GROUP BY sk, level, idx // 3),
sub AS (SELECT sk, level AS top, h AS subroot, row_number() OVER (ORDER BY sk) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
up(level, idx, h, n) AS (SELECT 0, idx, subroot, n FROM sub
      UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3)
      FROM up WHERE n > 1 GROUP BY level, idx // 3),
chain AS (SELECT p.doc_id, p.leaf, p.other, p.sk, p.idx, l.level, q.level AS lev, q.h, q.idx AS pos, false AS upper FROM p
      JOIN (SELECT DISTINCT sk, level FROM low WHERE n > 1) l USING (sk) JOIN low q ON q.sk = p.sk AND q.level = l.level
      AND q.idx // 3 = (p.idx // (3 ** l.level)::BIGINT) // 3
      UNION ALL SELECT p.doc_id, p.leaf, p.other, p.sk, p.idx, 1000 + l.level, q.level, q.h, q.idx, true FROM p JOIN sub USING (sk)
      JOIN (SELECT DISTINCT level FROM up WHERE n > 1) l ON true JOIN up q ON q.level = l.level
      AND q.idx // 3 = (sub.idx // (3 ** l.level)::BIGINT) // 3),
steps AS (SELECT c.sk, c.idx, c.level,
      coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < me), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > me), '') AS r
      FROM (SELECT chain.*, CASE WHEN upper THEN sub.idx // (3 ** lev)::BIGINT ELSE chain.idx // (3 ** lev)::BIGINT END AS me
            FROM chain JOIN sub USING (sk)) c GROUP BY 1, 2, 3),
paths AS (SELECT sk, idx, list({{'l': l, 'r': r}} ORDER BY level) AS path, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY 1, 2),
root AS (SELECT h AS root FROM up WHERE n = 1),
f AS (SELECT p.*, coalesce(proof, sha256('')) AS proof_sha256, list_reduce(list_prepend({{'l': p.other, 'r': ''}}, coalesce(path, [])),
      lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM p LEFT JOIN paths USING (sk, idx))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f JOIN sub USING (sk), root"""}
