"""Prefix trie of conversations by truncation peeling.

Every turn becomes a digest, every conversation a chain of keys: a key stands for all turns up to its
own. Peeling begins at the greatest depth: the conversations that end at a depth and what the depth
below left are grouped, which gives nodes and adds up their subtrees at once; then every node loses its
last turn and goes on as one row. A conversation is therefore one row where it ends, and a common
beginning one row per level, however many conversations share it.

Depths at which nothing merges need no regrouping: a depth where the different keys are as many as the
keys below it and the ends at it together. Between two merging depths a row is stripped of all its turns
in one step, and the nodes on its way come from the turns of its smallest member, with the same members
and leaves, and savings by prefix sums of the turns' bytes. So there is one stage per merging depth, not
per turn of the longest conversation, and every turn is read once.

The turns of a conversation and of those that borrow from it meet in one partition and are streamed
in order; a task holds the first turns of one conversation, whatever the lengths. Ends are hashed from
a range sort: runs of ids are joined to chunks by many tasks, and a node's chunks are fed through
SHA-256 in order, so no list of ids is held.

Nulls: a null role or text is empty, a null turn comes first; rows with a null conv_id belong to no
conversation and are left out. Turns of equal number are ordered by the digest of their role and text;
repeated rows are turns of their own. An empty table has no node, not even a root. conv_id - conv_id % 5
keeps the sign of conv_id, as the remainder does. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setscore.llm.common import materialise, table

FAMILY = 5                   # conversations that begin with turns of one of them
BORROWED = 9                 # a conversation borrows fewer turns than this
CHUNK = 4_096                # ids joined to one string
ROWS = 2_048                 # rows of an Arrow batch that a task gives out

TURNS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("size", pa.int64()),
                   ("upto", pa.int64()), ("ended", pa.bool_())])
TURNS_DDL = "conv_id long, depth long, key binary, parent_key binary, size long, upto long, ended boolean"


def borrowed_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % BORROWED


def _chain(conv_id: int, turns):
    """The rows of one rebuilt conversation, the root's first."""
    row = (conv_id, 0, b"", None, 0, 0)
    for digest, size in turns:
        yield (*row, False)
        _, depth, key, _, _, upto = row
        row = (conv_id, depth + 1, hashlib.blake2b(key + digest, digest_size=16).digest(), key, size, upto + size)
    yield (*row, True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rebuild(batches):
    """The rows of all rebuilt conversations, from turns sorted by family, its first conversation, conv_id and turn."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

    def grouped():
        """(family, conv_id, its turns) one after another."""
        it = rows()
        row = next(it, None)
        while row is not None:
            family, conv_id = row[:2]

            def own(family=family, conv_id=conv_id):
                nonlocal row
                while row is not None and row[:2] == (family, conv_id):
                    yield row[2:]
                    row = next(it, None)

            turns = own()
            yield family, conv_id, turns
            for _ in turns:
                pass

    def conversations():
        family, lead = None, []
        for at, conv_id, turns in grouped():
            if at != family:
                family, lead = at, []
            n = borrowed_turns(conv_id)
            if conv_id == at:
                for turn in turns:           # what others of the family may borrow
                    lead.append(turn)
                    if len(lead) == BORROWED - 1:
                        break
                yield conv_id, [(iter(lead)), turns]
            else:
                yield conv_id, [iter(lead[:n]), (turn for k, turn in enumerate(turns) if k >= n)]

    out = []
    for conv_id, parts in conversations():
        for row in _chain(conv_id, (turn for part in parts for turn in part)):
            out.append(row)
            if len(out) == ROWS:
                yield _batch(out, TURNS)
                out = []
    if out:
        yield _batch(out, TURNS)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent_key, size, upto, ended): the rebuilt conversations' turns after a root's
    row; size is the bytes of the turn's text, upto those of all texts up to it."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    conv_id = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(
        (conv_id - conv_id % FAMILY).alias("family"), conv_id.alias("conv_id"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size"), F.col("turn").alias("turn"))
    ordered = turns.repartition("family").sortWithinPartitions(
        "family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return ordered.select("family", "conv_id", "digest", "size").mapInArrow(_rebuild, TURNS_DDL)


def _chunks(batches):
    """(key, first id, ids joined) from (key, conv_id) rows in order."""
    key, ids, out = None, [], []
    schema = pa.schema([("key", pa.binary()), ("first_id", pa.int64()), ("ids", pa.string())])

    def closed():
        return {"key": key, "first_id": ids[0], "ids": ",".join(map(str, ids))}

    for batch in batches:
        for at, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (at != key or len(ids) == CHUNK):
                out.append(closed())
                ids = []
                if len(out) == ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            key = at
            ids.append(conv_id)
    if ids:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _hashed(batches):
    """(key, SHA-256 of its ids) from chunks in order."""
    schema = pa.schema([("end_key", pa.binary()), ("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        out = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and at == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append({"end_key": key, "ends_sha256": state.hexdigest()})
                key, state = at, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"end_key": key, "ends_sha256": state.hexdigest()}], schema=schema)


def ends(turns: DataFrame) -> DataFrame:
    """(end_key, ends_sha256) of every node at which conversations end."""
    rows = turns.where("ended").select("key", "conv_id")
    chunks = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first_id long, ids string")
    ordered = chunks.repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids")
    return ordered.mapInArrow(_hashed, "end_key binary, ends_sha256 string")


def merging_depths(turns: DataFrame) -> list[int]:
    """Depths, greatest first, at which a node has more than one child or a child and an end; 0 is always the last."""
    keys = turns.groupBy("depth", "key").agg(F.max(F.col("ended").cast("int")).alias("ends"))
    levels = keys.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends"))
    below = levels.select((F.col("depth") - 1).alias("over"), F.col("n").alias("n_below"))
    merging = levels.join(below, F.col("depth") == F.col("over"), "left").where((F.coalesce("n_below", F.lit(0)) + F.col("ends") > F.col("n")) | (F.col("depth") == 0))
    return sorted((r.depth for r in merging.select("depth").collect()), reverse=True)


_NODE = ["conv_id", "depth", "key", "parent_key", "size", "upto", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialise(rebuilt(conversations).sortWithinPartitions("depth"), "trie-turns")
    depths = merging_depths(turns)
    if not depths:
        return conversations.sparkSession.createDataFrame([], RESULT)
    one = F.lit(1).cast("long")
    own = (F.col("n_convs") - 1) * F.col("size")
    # conversations with the same turns end as one row
    leaves = turns.where("ended").groupBy("key", "parent_key", "depth", "size", "upto").agg(F.min("conv_id").alias("conv_id"), F.count(one).alias("n_convs"))
    leaves = materialise(leaves.withColumns({"n_children": one - 1, "n_leaves": one, "saved_tokens": own}).select(*_NODE).sortWithinPartitions("depth"), "trie-ends")
    nodes, every = None, []
    for before, depth in zip([None, *depths], depths, strict=False):
        # what the merging depth before left, and what ends between that and this one, go up to this one
        up = leaves.where(F.col("depth") > depth)
        if before is not None:
            up = up.where(F.col("depth") < before).unionByName(nodes)
        every.append(up.where(F.col("depth") < before) if before is not None else up)
        member = up.select(F.col("conv_id").alias("member"), F.col("depth").alias("top"), (F.col("upto") - F.col("size")).alias("over"),
                           "n_convs", "n_leaves", "saved_tokens")
        way = turns.where(F.col("depth") >= depth)
        if before is not None:
            way = way.where(F.col("depth") < before)
        way = way.join(member, (F.col("conv_id") == F.col("member")) & (F.col("depth") < F.col("top")))
        passed = (F.col("n_convs") - 1) * (F.col("over") - F.col("upto"))          # by the turns between
        on_way = way.withColumns({"n_children": one, "saved_tokens": F.col("saved_tokens") + passed})
        on_way = materialise(on_way.select(*_NODE), "trie-way")
        every.append(on_way.where(F.col("depth") > depth).withColumn("saved_tokens", F.col("saved_tokens") + own))
        here = on_way.where(F.col("depth") == depth).unionByName(leaves.where(F.col("depth") == depth).withColumns({"n_leaves": one - 1, "saved_tokens": one - 1}))
        level = here.groupBy("key", "parent_key", "depth", "size", "upto").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _NODE[6:]])
        level = level.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + own})
        nodes = materialise(level.select(*_NODE), "trie-nodes")
        every.append(nodes)
    every = materialise(reduce(DataFrame.unionByName, every), "trie-every")
    parents = every.where("n_children > 0").select(F.col("key").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    out = every.join(parents, F.col("parent_key") == F.col("of"), "left").join(ends(turns), F.col("key") == F.col("end_key"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", *_NODE[6:], F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def op13_truncation_peeling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_truncation_peeling": op13_truncation_peeling}

# CRC-32, bit by bit (polynomial 0xEDB88320)
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"""

ORACLE_SQL = {"op13_truncation_peeling": f"""
WITH t AS (SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS dig,
      strlen(coalesce(text, ''))::BIGINT AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) - 1 AS p FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, p, dig, size FROM c JOIN o ON o.conv_id = c.base AND p < h
      UNION ALL SELECT c.conv_id, 1, p, dig, size FROM c JOIN o USING (conv_id) WHERE p >= h),
pre AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(dig, '') OVER w AS key, size, NULL FROM r
        WINDOW w AS (PARTITION BY conv_id ORDER BY part, p ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0, NULL FROM c),
z AS (SELECT conv_id, max(depth) AS depth FROM pre GROUP BY 1),
n AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM pre GROUP BY key),
k AS (SELECT substr(key, 1, length(key) - 64) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
s AS (SELECT pre.key, sum((u.n_convs - 1) * u.size)::BIGINT AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
      FROM u JOIN pre ON pre.conv_id = u.conv_id AND pre.depth <= u.depth GROUP BY pre.key),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM pre JOIN z USING (conv_id, depth) GROUP BY key)
SELECT u.conv_id, u.depth, q.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM u JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN n q ON u.depth > 0 AND q.key = substr(u.key, 1, length(u.key) - 64)"""}
