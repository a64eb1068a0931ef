"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Different vectors are hashed into shards of bounded size. A task builds its shard's graph: vectors come
in batches; greedy searches through the graph so far propose their neighbours, and relaxed pruning keeps
a candidate only if no kept neighbour is nearer to it than the vector itself is, by the factor ``ALPHA``,
so that edges point in diverse directions. Edges are added both ways; a node that gets too many is pruned
in the same way. The graphs are written to the shared folder: an index row per vector.

Queries search every shard of their dimension by beam search, many at a time: blocks of queries meet
shards by (shard, block), so the query set is a stated block product with the shards. What a beam ends
with is scored again in double precision on the original vectors; a query's best of all shards remain.

Copies of a vector are one node, which carries its ``k`` + 1 smallest vec_ids: no more can be among the
k nearest. So copies neither crowd a graph nor pass through one task.

Similarity is the cosine. Vectors that are null, empty or zero, or hold null or non-finite components,
and rows with a null vec_id take no part, as queries or as candidates. Vectors are compared with those of
their own length. Repeated rows are one row; where a vec_id has several vectors, each is a query of its
own and none is a candidate of another. Ties go to the smaller vec_id. An empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setscore.llm.common import materialise, table

DEGREE = 32                  # edges that pruning leaves
SLACK = 48                   # edges of a node before it is pruned
ALPHA = 1.2                  # of distances
BEAM = 64                    # candidates of a greedy search while building
SEARCH_BEAM = 96             # and of a query
WIDTH = 4                    # nodes that a search expands at a time
ENTRIES = 12                 # nodes that a search begins with
BATCH = 256                  # searches at a time
SHARD_ROWS = 8_192           # vectors of a shard, on average
SHARD_BYTES = 64 << 20       # and bytes of them, in single precision
QUERY_ROWS = 16_384          # queries of a block
K = 5
EVERY = 50                   # vec_ids divisible by it are queries
SEED = 11


# ---- one shard, in a task ---------------------------------------------------

def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)      # squares neither vanish nor overflow
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(graph: np.ndarray, points: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ``beam`` best nodes that greedy searches meet, best first; -1 where there are none.

    All queries go on together; each expands its WIDTH best nodes that it hasn't expanded yet.
    """
    b, n = len(queries), len(points)
    row = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, dtype=np.int32)
    sims = np.full((b, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)      # the last place stands for no node
    seen[:, n] = True
    slot = np.zeros((b, n + 1), dtype=np.int16)
    new = np.broadcast_to(entries.astype(np.int32), (b, len(entries)))
    live = np.arange(b)
    while len(live):
        r = row[:len(live)]
        # a node that several expanded nodes lead to counts once: the last of its places does
        at, node = live[:, None], np.where(new < 0, n, new)
        order = np.arange(new.shape[1], dtype=np.int16)[None, :]
        slot[at, node] = order
        ok = ~seen[at, node] & (slot[at, node] == order)
        seen[at, node] = True
        safe = np.where(new < 0, 0, new)
        sim = np.matmul(points[safe], queries[live][:, :, None])[:, :, 0]
        sim[~ok] = -np.inf
        all_ids = np.concatenate([ids[live], np.where(ok, new, -1)], axis=1)
        all_sims = np.concatenate([sims[live], sim], axis=1)
        all_open = np.concatenate([open_[live], ok], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        now_ids, now_open = all_ids[r, best], all_open[r, best]
        ids[live], sims[live] = now_ids, all_sims[r, best]
        # the first WIDTH open ones are expanded
        rank = np.cumsum(now_open, axis=1)
        pick = now_open & (rank <= WIDTH)
        open_[live] = now_open & ~pick
        going = pick.any(axis=1)
        live, now_ids, pick = live[going], now_ids[going], pick[going]
        if len(live):
            where = np.argsort(~pick, axis=1, kind="stable")[:, :WIDTH]
            r = row[:len(live)]
            chosen = np.where(pick[r, where], now_ids[r, where], -1)
            new = np.where(chosen[:, :, None] >= 0, graph[np.where(chosen < 0, 0, chosen)], -1).reshape(len(live), -1)
    return ids, sims


def robust_prune(points: np.ndarray, centre: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Per row, at most ``degree`` of the candidates (-1: none): the nearest, then the nearest that isn't
    nearer, ``alpha`` times, to one kept before."""
    b, c = candidates.shape
    safe = np.where(candidates < 0, 0, candidates)
    near = points[safe]
    dist = 2 - 2 * np.matmul(near, points[centre][:, :, None])[:, :, 0]
    between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
    order = np.sort(candidates, axis=1)
    repeated = np.zeros((b, c), dtype=bool)
    if (order[:, 1:] == order[:, :-1]).any():
        by = np.argsort(candidates, axis=1, kind="stable")
        repeated[np.arange(b)[:, None], by[:, 1:]] = np.take_along_axis(candidates, by, 1)[:, 1:] == np.take_along_axis(candidates, by, 1)[:, :-1]
    alive = (candidates >= 0) & (candidates != centre[:, None]) & ~repeated
    out = np.full((b, degree), -1, dtype=np.int32)
    rows = np.arange(b)
    for k in range(degree):
        at = np.where(alive, dist, np.inf).argmin(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = candidates[rows, at][some]
        alive &= alpha * alpha * between[rows, at] > dist
        alive[rows, at] = False
    return out


def build_graph(points: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): per node its neighbours, -1 where there are fewer, and the nodes where searches begin."""
    n = len(points)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n).astype(np.int32)
    entries = order[:ENTRIES]
    graph = np.full((n, SLACK), -1, dtype=np.int32)
    degree = np.zeros(n, dtype=np.int64)

    def insert(batch: np.ndarray, found: np.ndarray) -> None:
        edges = robust_prune(points, batch, found, DEGREE, ALPHA)
        graph[batch] = -1
        graph[batch, :DEGREE] = edges
        degree[batch] = (edges >= 0).sum(axis=1)
        # the way back
        at, k = np.nonzero(edges >= 0)
        to, back = edges[at, k], batch[at]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        node, first, count = np.unique(to, return_index=True, return_counts=True)
        fits = degree[node] + count <= SLACK
        for fit in (True, False):
            chosen = np.flatnonzero(fits == fit)
            for part in np.array_split(chosen[np.argsort(count[chosen], kind="stable")], max(1, -(-len(chosen) // BATCH))):
                if not len(part):
                    continue
                most = int(count[part].max())
                take = np.arange(most)[None, :]
                more = np.where(take < count[part][:, None], back[np.minimum(first[part][:, None] + take, len(back) - 1)], -1)
                if fit:
                    r, c = np.nonzero(more >= 0)
                    graph[node[part][r], degree[node[part]][r] + c] = more[r, c]
                    degree[node[part]] += count[part]
                else:
                    kept = robust_prune(points, node[part], np.concatenate([graph[node[part]], more], axis=1), DEGREE, ALPHA)
                    graph[node[part]] = -1
                    graph[node[part], :DEGREE] = kept
                    degree[node[part]] = (kept >= 0).sum(axis=1)

    start = min(n, 2 * DEGREE)
    head = order[:start]
    insert(head, np.broadcast_to(head, (start, start)).copy())
    at = start
    while at < n:
        batch = order[at:at + min(BATCH, at)]
        found, _ = beam_search(graph, points, entries, points[batch], BEAM)
        insert(batch, found)
        at += len(batch)
    return graph, entries


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    v, q = vectors / np.abs(vectors).max(axis=1, keepdims=True), query / np.abs(query).max()
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


# ---- the index --------------------------------------------------------------

def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the different rows that take part, in double precision, zeros without sign."""
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids) of (vec_id, vector): every different vector with its ``keep`` smallest vec_ids."""
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    # repeated rows share a rank; the limit on it is applied before and after the shuffle
    few = rows.groupBy("vector", "vec_id").agg(F.lit(1)).select("vector", "vec_id").withColumn("rank", rank).where(F.col("rank") <= keep)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("node", pa.int32()), ("entry", pa.bool_()), ("ids", pa.list_(pa.int64())),
                    ("vector", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32()))])
_INDEX_DDL = "dim int, shard long, node int, entry boolean, ids array<long>, vector array<double>, edges array<int>"


def _build(shard: pa.Table) -> pa.Table:
    dim = shard.column("dim")[0].as_py()
    shard = shard.take(pa.compute.sort_indices(shard.append_column("first", pa.compute.list_element(shard.column("ids"), 0)), [("first", "ascending")]))
    graph, entries = build_graph(unit(_matrix(shard.column("vector"), dim)))
    n = len(shard)
    entry = np.zeros(n, dtype=bool)
    entry[entries] = True
    edges = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SLACK), pa.array(graph.reshape(-1)))
    return pa.table([shard.column("dim"), shard.column("shard"), pa.array(np.arange(n, dtype=np.int32)), pa.array(entry), shard.column("ids"),
                     shard.column("vector"), edges], schema=_INDEX)


def shard_rows(dim: Column) -> Column:
    """Vectors of a shard, by their length."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARD_ROWS), F.floor(F.lit(SHARD_BYTES / 4) / dim)))


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> tuple[DataFrame, DataFrame]:
    """The index, (dim, shard, node, entry, ids, vector, edges), and (dim, shards), both written to the shared folder."""
    vectors = materialise(distinct_vectors(vectors_of(rows, id_col, vector_col), k + 1).withColumn("dim", F.size("vector")), "ann-vectors")
    shards = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    shards = materialise(shards.select("dim", F.ceil(F.col("n") / shard_rows(F.col("dim"))).cast("long").alias("shards")), "ann-shards")
    dealt = vectors.join(shards.withColumnRenamed("dim", "of"), F.col("dim") == F.col("of"))
    dealt = dealt.select("dim", F.pmod(F.xxhash64("vector"), F.col("shards")).alias("shard"), "ids", "vector")
    # a shard is much work and few bytes: one task each
    tasks = int(shards.agg(F.sum("shards")).first()[0] or 1)
    dealt = dealt.repartition(max(tasks, dealt.sparkSession.sparkContext.defaultParallelism), "dim", "shard")
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX_DDL), "ann-index"), shards


# ---- searching --------------------------------------------------------------

_FOUND_DDL = "query_id long, query_key long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int, beam: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(index) or not len(asked):
            return _FOUND.empty_table()
        dim = index.column("dim")[0].as_py()
        index = index.sort_by("node")
        vectors = _matrix(index.column("vector"), dim)
        points, graph = unit(vectors), _matrix(index.column("edges"), SLACK)
        entries = np.flatnonzero(index.column("entry").to_numpy())
        ids = index.column("ids").to_pylist()
        queries = _matrix(asked.column("vector"), dim)
        names, keys = asked.column("query_id").to_pylist(), asked.column("query_key").to_pylist()
        out = []
        for at in range(0, len(queries), BATCH):
            nodes, _ = beam_search(graph, points, entries, unit(queries[at:at + BATCH]), beam)
            # single precision may swap near ties: more than k are scored again
            for j, found in enumerate(nodes[:, :4 * (k + 1)]):
                found = found[found >= 0]
                own = names[at + j]
                best = sorted((-s, i) for node, s in zip(found, cosines(vectors[found], queries[at + j]).tolist(), strict=True) for i in ids[node] if i != own)[:k]
                out.extend((own, keys[at + j], i, -s) for s, i in best)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()
    return run


def search(index: DataFrame, shards: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that the index finds for (vec_id, vector) queries.

    ``k`` must be no more than the index was built for.
    """
    asked = queries.groupBy("vec_id", "vector").agg(F.lit(1)).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_key"), "vector", F.size("vector").alias("q_dim"))
    asked = materialise(asked, "ann-queries")
    count = asked.groupBy("q_dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("blocks"))
    plan = materialise(count.join(shards, F.col("q_dim") == F.col("dim")).select("q_dim", "blocks", "shards"), "ann-plan")
    tasks = int(plan.agg(F.sum(F.col("blocks") * F.col("shards"))).first()[0] or 1)
    cells = plan.select(F.col("q_dim").alias("p_dim"), "blocks", "shards")
    zero = F.lit(0).cast("long")
    left = index.join(cells, F.col("dim") == F.col("p_dim")).select(*index.columns, F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    right = asked.join(cells, F.col("q_dim") == F.col("p_dim")).select(
        "query_id", "query_key", "vector", F.col("q_dim").alias("dim"), F.pmod(F.xxhash64("query_id", "query_key"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(zero, F.col("shards") - 1)).alias("shard"))
    n = max(tasks, index.sparkSession.sparkContext.defaultParallelism)
    cell = ["dim", "shard", "block"]
    found = left.repartition(n, *cell).groupBy(*cell).cogroup(right.repartition(n, *cell).groupBy(*cell)).applyInArrow(_search(k, beam), _FOUND_DDL)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index, shards = build_index(rows)
    return search(index, shards, vectors_of(rows, "vec_id", "embedding").where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op11_robust_graph": op11_robust_graph}
