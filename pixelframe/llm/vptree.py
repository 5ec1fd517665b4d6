"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

The trees are written as a table. The queries, in blocks of a bounded size, go to all tasks, each of which takes its trees
one after the other and carries the best so far of each query, which prunes the next tree; so neither trees nor queries
are shuffled for the search, and what it gives is as many rows as tasks find.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries a zero: then a larger inner product
is a smaller Euclidean distance, to which the triangle inequality applies. A subtree is left out where the bound on its
distances, times the factor, is beyond the k-th best so far; with a factor of 1 the search is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_parts, shared_dir, written

#: Vectors in a shard and in a leaf; queries that go through a tree at once.
SHARD, LEAF, AT_ONCE = 8192, 256, 1024
#: Bytes of queries that go to all tasks at once; more go in blocks, one after the other.
BLOCK = 32 << 20
#: Bytes of vectors whose trees one task builds, if there are as many.
PART = 64 << 20
#: What rounding may take from a bound or a product, relative to the norms.
SLACK = 1e-9
_FOUND = "query_uid long, query_id long, uid long, vec_id long, score double"


def _power(x: np.ndarray) -> np.ndarray:
    """Powers of two that bring the largest component of each row to between a half and 1."""
    return np.ldexp(1.0, -np.frexp(np.abs(x).max(-1))[1].clip(-1020, 1020)) if x.shape[-1] else np.ones(x.shape[:-1])


class VantagePointTree:
    """A tree over the rows of `vectors`; `search` takes many queries at once. Distances and bounds are of vectors times a power
    of two, so that their squares neither overflow nor vanish; products are of the vectors as they are."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, nodes: list[tuple] | None = None):
        self.given = np.asarray(vectors, np.float64)
        self.power = float(_power(self.given.reshape(1, -1))[0]) if self.given.size else 1.0
        self.vectors = self.given * self.power
        norms = (self.vectors**2).sum(1)
        self.largest = float(norms.max()) if len(norms) else 0.0
        self.more = np.sqrt(np.maximum(self.largest - norms, 0.0))
        #: (rows) of a leaf, or (vantage row, radii of the near part, radii of the far part, near, far)
        self.nodes: list[tuple] = [] if nodes is None else nodes
        if nodes is None:
            self._build(np.arange(len(vectors)), leaf)

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        square = ((self.vectors[rows] - self.vectors[to]) ** 2).sum(1) + (self.more[rows] - self.more[to]) ** 2
        return np.sqrt(square)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        place = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= leaf:
            self.nodes[place] = (rows,)
            return place
        # the row furthest from an arbitrary one lies at an edge, where radii tell most
        vantage = int(rows[np.argmax(self._distances(rows, int(rows[0])))])
        d = self._distances(rows, vantage)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        radii = (float(d[near[0]]), float(d[near[-1]])), (float(d[far[0]]), float(d[far[-1]]))
        self.nodes[place] = (vantage, *radii, self._build(rows[near], leaf), self._build(rows[far], leaf))
        return place

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, skip: np.ndarray, factor: float = 1.0, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, product) of each query's `k` best rows, ties to the smaller id; row skip[i] isn't a candidate of
        query i (-1: none). best: the k-th best product so far of each query (-inf: none), below which rows don't count."""
        given = np.asarray(queries, np.float64)
        power = _power(given)
        queries = given * power[:, None]
        squares = (queries**2).sum(1)
        # a product of the scaled vectors is one of the vectors times this; what may be lost below the smallest double counts
        with np.errstate(over="ignore", under="ignore"):
            scale = power * self.power
            lost = np.where(np.isinf(scale), np.inf, (given.shape[1] + 1) * np.finfo(float).tiny * scale)
            most = np.finfo(float).max * scale  # beyond it all products are as large
        slack = SLACK * (1 + np.sqrt(squares * self.largest)) + lost

        def scaled(exact: np.ndarray, q: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                out = np.where(np.isposinf(exact), most[q], exact * power[q] * self.power)
            return np.where(np.isnan(out), -np.inf, out)

        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        bound = np.full(len(queries), -np.inf) if best is None else scaled(best, np.arange(len(queries)))  # the k-th best product

        def reach(active: np.ndarray) -> np.ndarray:
            """The distance of the k-th best, a little widened."""
            return np.sqrt(np.maximum(self.largest + squares[active] - 2 * (bound[active] - slack[active]), 0.0))

        def at_leaf(rows: np.ndarray, active: np.ndarray) -> None:
            nonlocal found
            about = queries[active] @ self.vectors[rows].T
            q, r = np.nonzero(about >= (bound[active] - slack[active])[:, None])
            q, r = active[q], rows[r]
            mine = skip[q] != r
            q, r = q[mine], r[mine]
            exact = np.zeros(len(q))
            with np.errstate(over="ignore", invalid="ignore"):
                for c in range(given.shape[1]):  # in the components' order: equal vectors get equal products
                    exact += given[q, c] * self.given[r, c]
            old = np.isin(found[0], active)
            q, r, exact = (np.concatenate([f[old], n]) for f, n in zip(found, (q, r, exact), strict=True))
            order = np.lexsort((ids[r], -exact, q))
            q, r, exact = q[order], r[order], exact[order]
            first = np.searchsorted(q, q)
            rank = np.arange(len(q)) - first
            keep = rank < k
            found = [np.concatenate([f[~old], n[keep]]) for f, n in zip(found, (q, r, exact), strict=True)]
            last = rank == k - 1
            bound[q[last]] = np.maximum(bound[q[last]], scaled(exact[last], q[last]))

        def visit(place: int, active: np.ndarray) -> None:
            if not len(active):
                return
            node = self.nodes[place]
            if len(node) == 1:
                if len(node[0]):
                    at_leaf(node[0], active)
                return
            vantage, near, far, left, right = node
            product = queries[active] @ self.vectors[vantage]
            d = np.sqrt(np.maximum(self.largest + squares[active] - 2 * product, 0.0))
            inner = d <= (near[1] + far[0]) / 2
            for side, (radii, child) in ((inner, (near, left)), (~inner, (far, right)), (inner, (far, right)), (~inner, (near, left))):
                least = np.maximum(np.maximum(radii[0] - d[side], d[side] - radii[1]), 0.0)
                visit(child, active[side][least * factor <= reach(active[side]) * (1 + SLACK) + SLACK])

        if len(self.vectors):
            visit(0, np.arange(len(queries)))
        return found[0], found[1], found[2]


def _vectors(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, size)


def _tree(key: tuple, rows: pa.Table) -> pa.Table:
    vectors = _vectors(rows.column("embedding"), key[0].as_py())
    tree = VantagePointTree(vectors)
    ids = rows.column("vec_id")
    kept = (vectors, tree.nodes, np.asarray(rows.column("uid")), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
    return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(kept, 5)], pa.binary())})


class Best:
    """The `k` best rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.bound = k, np.full(n, -np.inf)
        self.held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, float)]  # query, uid, id, without one, product

    def take(self, *rows: np.ndarray) -> None:
        q, uid, ids, no_id, score = (np.concatenate(x) for x in zip(self.held, rows, strict=True))
        order = np.lexsort((uid, np.where(no_id, np.iinfo(np.int64).max, ids), -score, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.held = [x[order] for x in (q, uid, ids, no_id, score)]
        last = order[rank == self.k - 1]
        self.bound[q[last]] = score[last]


def _searched(queries, k: int, factor: float):
    """queries: a broadcast of (uids, ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_uid, query_id, wanted = queries.value
        best = Best(len(query_uid), k)
        for batch in batches:
            for tree in batch.column("tree"):
                vectors, nodes, uid, vec_id, no_id = pickle.loads(tree.as_py())
                index = VantagePointTree(vectors, nodes=nodes)
                by_uid = np.argsort(uid)
                at = np.minimum(np.searchsorted(uid[by_uid], query_uid), len(uid) - 1)
                skip = np.where(uid[by_uid][at] == query_uid, by_uid[at], -1)
                order = np.where(no_id, np.iinfo(np.int64).max, vec_id)
                for a in range(0, len(query_uid), AT_ONCE):
                    some = slice(a, a + AT_ONCE)
                    q, r, score = index.search(wanted[some], k, order, skip[some], factor, best.bound[some])
                    best.take(q + a, uid[r], vec_id[r], no_id[r], score)
        q, uid, ids, no_id, score = best.held
        for a in range(0, len(q), 1 << 16):
            some = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(query_uid[q[some]]), pa.array(query_id[q[some]]), pa.array(uid[some]), pa.array(ids[some], mask=no_id[some]), pa.array(score[some])], names=["query_uid", "query_id", "uid", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the `k` nearest rows of each row of `embeddings` (vec_id, embedding) whose vec_id
    is divisible by `every`, by largest inner product in double precision; ties to the smaller vec_id, null ids last.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors meet those of their
    own length alone. Rows with equal ids are searched and found apart; a row isn't its own neighbour. With fewer
    candidates than k all are returned; an empty table gives none. Products beyond the largest double are infinite and tie;
    where infinities of both signs meet in a product it is not a number and comes last.

    factor: times the triangle bound; 1 is exact, more prunes more. shard: vectors in a tree. block: bytes of queries that
    are sent to all tasks at once."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    spark = embeddings.sparkSession
    folder = shared_dir(spark)
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"), F.size(e).alias("size")).where(F.coalesce(fine, F.lit(False)))
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    counts = rows.groupBy("size").agg(F.count(F.lit(1)), F.sum(is_query.cast("long"))).collect()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not counts:
        return none
    shards = F.create_map(*(F.lit(x) for size, n, _ in counts for x in (size, -(-n // shard))))
    of = lambda m, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), m[F.col("size")])
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(n * size * 8 for size, n, _ in counts) // PART))
    dealt = rows.withColumn("shard", of(shards, 1)).repartition(min(tasks, sum(-(-n // shard) for _, n, _ in counts)), "size", "shard")
    trees = written(dealt.groupBy("size", "shard").applyInArrow(_tree, "size int, tree binary"), f"{folder}/trees")
    parts = {size: max(1, -(-n * size * 8 // block)) for size, _, n in counts}
    asked = rows.where(is_query).withColumn("part", of(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), 2))
    asked = written(asked.select("size", "part", "uid", "vec_id", "embedding"), f"{folder}/queries")
    found = None
    for size, _, n in counts:
        for part in range(parts[size] if n else 0):
            mine = asked.where((F.col("size") == size) & (F.col("part") == part)).select("uid", "vec_id", "embedding").toArrow()
            if not mine.num_rows:
                continue
            sent = spark.sparkContext.broadcast((np.asarray(mine.column("uid")), np.asarray(mine.column("vec_id")), _vectors(mine.column("embedding"), size)))
            got = trees.where(F.col("size") == size).select("tree").mapInArrow(in_parts(_searched(sent, k, factor), 1), _FOUND)
            got.write.mode("append").parquet(f"{folder}/found")
            found = f"{folder}/found"
            sent.unpersist()
    if found is None:
        return none
    best = Window.partitionBy("query_uid").orderBy(F.isnan("score"), F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return spark.read.schema(_FOUND).parquet(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.u AS qu, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i::INT] * c.e[i::INT]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.u <> c.u AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qu ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
