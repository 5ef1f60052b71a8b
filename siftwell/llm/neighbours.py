"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small
classifier learns the parts (of a vector and of its neighbours) from the
vector; every vector is indexed under its likeliest part, and a query is routed
to its several likeliest parts, whose vectors are ranked by exact inner
products. How many parts a query visits is chosen on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, random_rows, stored

#: Bound of the sample that the index is fitted on.
SAMPLE_ROWS = 6000
MOST_PARTS = 256
#: Share of a held-back sixth of the sample's neighbours that the visited parts must hold.
LEAST_FOUND = 0.945
NEIGHBOURS = 20
HIDDEN, EPOCHS, SEED = 128, 40, 5
#: Vectors and queries that meet in one task at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part: with an id, not null, empty or zero, all components finite, of the commonest length.

    Rows that share a vec_id count as one, with the least vector. Other columns are left out.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    one = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return one.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of largest inner product with each, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, slack: float = 1.1) -> np.ndarray:
    """Parts of at most slack times the mean size that cut few edges.

    Starts from halvings along the longest direction and moves vertices to the
    part that holds most of their neighbours, largest gain first, while there
    is room.
    """
    part = np.zeros(len(x), np.int64)
    pieces, done = [np.arange(len(x))], 1
    while done < parts:
        biggest = max(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = pieces.pop(biggest)
        y = x[at] - x[at].mean(0)
        axis = np.linalg.svd(y[:: max(1, len(y) // 500)], full_matrices=False)[2][0]
        order = at[np.argsort(y @ axis, kind="stable")]
        pieces += [order[: len(order) // 2], order[len(order) // 2 :]]
        done += 1
    for p, at in enumerate(pieces):
        part[at] = p
    n, most = len(x), int(np.ceil(slack * len(x) / parts))
    sides = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    others = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (sides, part[others]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Two layers from a vector to log-probabilities of parts, and how many parts a query visits."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x * self.scale).astype(np.float32) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def fit(x: np.ndarray, n: int, least_found: float = LEAST_FOUND, seed: int = SEED) -> Router:
    """A router from the sample x, in random order, of n vectors. Its last sixth is not learned from and sets the visits."""
    every, x = x, x[: len(x) - len(x) // 6]
    parts = int(np.clip(round(np.sqrt(n) / 4), 1, min(MOST_PARTS, max(1, len(x) // 24))))
    r = np.random.default_rng(seed)
    d = x.shape[1]
    w1, b1 = (r.standard_normal((d, HIDDEN)) * np.sqrt(2 / d)).astype(np.float32), np.zeros(HIDDEN, np.float32)
    w2, b2 = (r.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN)).astype(np.float32), np.zeros(parts, np.float32)
    router = Router(float(1 / max(np.sqrt((x * x).mean()), 1e-30)), w1, b1, w2, b2, 1)
    if parts == 1:
        return router
    graph = neighbour_graph(x, min(10, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    target = np.eye(parts, dtype=np.float32)[part] * 0.5 + np.eye(parts, dtype=np.float32)[part[graph]].mean(1) * 0.5
    y = (x * router.scale).astype(np.float32)
    params = [w1, b1, w2, b2]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for i in range(0, len(y), 256):
            at = order[i : i + 256]
            z = y[at] @ w1 + b1
            h = np.maximum(z, 0)
            s = h @ w2 + b2
            p = np.exp(s - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[at]) / len(at)
            gh = (g @ w2.T) * (z > 0)
            step += 1
            for q, grad, m, v in zip(params, [y[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= 0.003 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # where the neighbours of the held-back vectors are indexed, in the order in which a query visits the parts
    logits = router.logits(every)
    asked = np.arange(len(x), len(every))
    ranks = np.argsort(np.argsort(-logits[asked], axis=1, kind="stable"), axis=1)
    near = neighbour_graph(every, min(NEIGHBOURS, len(every) - 1))[asked]
    visited = ranks[np.arange(len(asked))[:, None], logits.argmax(1)[near]]
    found = np.cumsum(np.bincount(visited.ravel(), minlength=parts)) / max(visited.size, 1)
    router.visits = min(parts, int(np.searchsorted(found, least_found)) + 1) if len(asked) else parts
    return router


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def top_products(queries: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and inner products of each query's k best vectors, itself left out; ties to the smaller id.

    The matrix product finds candidates to within its rounding; their products
    are then summed the same way for every pair, so equal vectors tie exactly.
    """
    longest = np.sqrt((x * x).sum(1)).max() if len(x) else 0.0
    out = []
    for i in range(0, len(queries), 256):
        s = queries[i : i + 256] @ x.T
        s[q_ids[i : i + 256, None] == ids[None]] = -np.inf
        n = min(k, s.shape[1])
        kth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        for j in range(len(s)):
            q = queries[i + j]
            at = np.flatnonzero((s[j] >= kth[j] - 1e-10 * longest * np.sqrt(q @ q)) & (s[j] > -np.inf))
            exact = (x[at] * q).sum(1)
            best = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best), q_ids[i + j]), ids[at[best]], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 20, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each vector whose id is divisible by `every`; see usable() for who takes part.

    Fewer vectors than k give all of them; no vectors give no rows. Ties fall to
    the smaller vec_id.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], schema)
    sample = random_rows(rows, n, sample_rows, [F.xxhash64("vec_id", F.lit(SEED)), F.col("vec_id")]).toPandas()
    x = np.stack(sample["v"].to_numpy())
    d = x.shape[1]
    distinct = np.sort(np.unique(x, axis=0, return_index=True)[1])  # in the sample's random order
    router = fit(x[distinct], n)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits = router.logits(_matrix(b.column("v"), d))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(logits.argmax(1), pa.int32())], ["vec_id", "v", "part"])

    indexed = stored(rows.mapInArrow(frugal(home), "vec_id long, v array<double>, part int"), "indexed")
    # one row a part: as many as the router has
    size = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}
    parts = len(router.b2)
    counts = np.array([size.get(p, 0) for p in range(parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-router.logits(_matrix(b.column("v"), d)), axis=1, kind="stable")
            # further parts until the visited ones hold several times k vectors
            held = np.cumsum(counts[order], axis=1)
            visits = np.maximum(router.visits, (held < 4 * k + 1).sum(1) + 1)
            visits = np.minimum(visits, parts)
            who = np.repeat(np.arange(b.num_rows), visits)
            chosen = order[np.arange(parts)[None] < visits[:, None]]
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(chosen, pa.int32())], ["query_id", "q", "part"])

    queries = stored(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(frugal(route), "query_id long, q array<double>, part int"), "routes")
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    # a part's vectors and queries are dealt into blocks that meet in pairs
    blocks = lambda held, most: F.element_at(F.array(*[F.lit(max(1, -(-held.get(p, 0) // most))) for p in range(parts)]), F.col("part") + 1)
    vector_blocks, query_blocks = blocks(size, BLOCK_ROWS), blocks(asked, BLOCK_QUERIES)
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = indexed.withColumn("vb", F.pmod(F.xxhash64("vec_id"), vector_blocks).cast("int")).withColumn("qb", upto(query_blocks))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), query_blocks).cast("int")).withColumn("vb", upto(vector_blocks))

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = top_products(np.stack(b["q"].to_numpy()), b["query_id"].to_numpy(), np.stack(a["v"].to_numpy()), a["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    key = ["part", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector against all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
