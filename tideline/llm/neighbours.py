"""Approximate nearest neighbours by learned partitions.

A bounded sample (``SAMPLE_ROWS``, the smallest hashes of vec_id) gives a neighbour graph. The graph is cut into balanced
parts (spectral halving, refined by swaps that lower the cut), and a small network learns which parts a vector's neighbours
are in. Every row is indexed under its ``HOMES`` most probable parts; every query goes to its most probable parts, as many as
reach ``TARGET_RECALL`` on held-back sample queries, and is reranked there by exact cosine in double precision.

A part is cut into blocks of about ``BLOCK_BYTES``, so a part that holds a third of all rows is many tasks. No row of the table is
copied for queries: it lies in one block of each of its parts, and a part's queries stream past every block of it, which returns its best k for each. Queries
for which the chosen parts hold fewer than k rows look into all parts.

Defined results: vectors that are null, zero, of another size than the most frequent one, or hold null or non-finite
components, and those whose length overflows or underflows in double precision, take no part, nor do null ids; rows that share a vec_id are one candidate (the best score counts) and one
query (the smallest vector); ties go to the smaller vec_id; fewer candidates than k are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, table, tidy

SAMPLE_ROWS = 8192
ROWS_A_PART = 256
MOST_PARTS = 128
GRAPH_K = 10
HIDDEN = 96
BLOCK_BYTES, LEAST_BLOCK = 8 << 20, 256
QUERY_ROWS, CANDIDATES = 256, 1 << 15
TARGET_RECALL = 0.95
HOMES = 2


def knn(x: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """The k nearest rows of x by cosine for each row of q, in blocks; unit vectors."""
    out = np.empty((len(q), k), np.int64)
    for i in range(0, len(q), 1024):
        s = q[i : i + 1024] @ x.T
        if skip_self:
            s[np.arange(len(s)), i + np.arange(len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def halve(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side (False or True) of each of n nodes: two equal halves with few edges (a, b) between them."""
    degree = np.maximum(np.bincount(a, minlength=n), 1).astype(float)
    root = np.sqrt(degree)
    v = rng.normal(size=n)
    for _ in range(60):  # the second eigenvector of the normalised adjacency
        v -= root * (root @ v) / (root @ root)
        v = 0.5 * (v + np.bincount(a, (v / root)[b], minlength=n) / root)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swap the nodes that gain most, in pairs
        other = np.bincount(a, side[a] != side[b], minlength=n)
        gain = 2 * other - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        some = int((gain[left[:m]] + gain[right[:m]] > 2).sum()) // 2
        if some == 0:
            break
        side[left[:some]], side[right[:some]] = True, False
    return side


def cut_graph(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """The part of each node of a neighbour graph; parts is a power of two and sizes differ by one at most a level."""
    n, rng = len(near), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    part = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        inside = part[a] == part[b]
        ia, ib = a[inside], b[inside]
        order = np.argsort(part[ia], kind="stable")
        ia, ib = ia[order], ib[order]
        bounds = np.searchsorted(part[ia], np.arange(part.max() + 2))
        local = np.empty(n, np.int64)
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            local[nodes] = np.arange(len(nodes))
            e = slice(bounds[p], bounds[p + 1])
            new[nodes] += halve(len(nodes), local[ia[e]], local[ib[e]], rng)
        part = new
    return part


@dataclass
class Router:
    layers: list[np.ndarray]

    def logits(self, unit: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(unit @ w1 + b1, 0) @ w2 + b2


def fit_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, seed: int = 11) -> Router:
    """A network with one hidden layer; target: a distribution over parts for each row."""
    rng, d, parts = np.random.default_rng(seed), x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            xb = x[some]
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[some]) / len(some)
            dh = (dz @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= (0.003 if epoch < epochs * 3 // 4 else 0.0006) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(p)


def learn(sample: np.ndarray, parts: int, k: int, target_recall: float) -> tuple[Router, int]:
    """The router and how many parts a query is sent to."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near = knn(x, x, min(GRAPH_K, len(x) - 1), True)
    part = cut_graph(near, parts)
    target = np.zeros((len(x), parts))
    for column in (np.arange(len(x))[:, None], near):
        np.add.at(target, (np.repeat(np.arange(len(x)), column.shape[1]), part[column].ravel()), 1 / column.shape[1])
    held = np.arange(len(x)) % 8 == 7  # the queries that set the number of parts are not learned from
    router = fit_router(x[~held], target[~held] / 2)
    logits = router.logits(x)
    homes = np.argsort(-logits, axis=1, kind="stable")[:, :HOMES]
    true = knn(x, x[held], min(k + 1, len(x)), False)
    rank = np.empty((held.sum(), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-logits[held], axis=1, kind="stable"), np.arange(parts)[None], axis=1)
    at = np.min([np.take_along_axis(rank, homes[true, h], axis=1) for h in range(homes.shape[1])], axis=0)
    mine = true == np.flatnonzero(held)[:, None]
    at = at[~mine]
    probes = next((m for m in range(1, parts + 1) if (at < m).mean() >= target_recall), parts)
    return router, probes


class Block:
    """Rows of one block, ready to be searched."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.norm = np.sqrt(np.einsum("nd,nd->n", self.x, self.x))
        self.start = np.flatnonzero(np.concatenate(([True], self.ids[1:] != self.ids[:-1])))

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query id, id and cosine of the k best ids for each query; an id's best row counts."""
        norm = np.sqrt(np.einsum("nd,nd->n", q, q))
        near = (q @ self.x.T) / (norm[:, None] * self.norm)
        near[query_ids[:, None] == self.ids] = -np.inf
        best = near if len(self.start) == len(self.ids) else np.maximum.reduceat(near, self.start, axis=1)
        least = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(q), -np.inf)
        chosen = near >= np.maximum(least, -2.0)[:, None] - 1e-9  # the product's rounding must not decide
        ends = np.cumsum(chosen.sum(axis=1))
        out, i = [], 0
        while i < len(q):  # of many equal vectors all are candidates: so many queries at a time that their candidates fit
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CANDIDATES, side="right")))
            row, col = np.nonzero(chosen[i:j])
            row += i
            exact = np.einsum("nd,nd->n", q[row], self.x[col]) / (norm[row] * self.norm[col])
            order = np.lexsort((-exact, self.ids[col], row))
            row, ids, exact = row[order], self.ids[col][order], exact[order]
            once = np.concatenate(([True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])))[: len(row)]
            row, ids, exact = row[once], ids[once], exact[once]
            order = np.lexsort((ids, -exact, row))
            row, ids, exact = row[order], ids[order], exact[order]
            some = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((query_ids[row[some]], ids[some], exact[some]))
            i = j
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v)
    return vector.isNotNull() & fine & (square > 0) & (square < float("inf"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", target_recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id and score for each query row against all other rows."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d, n = sizes[0]
    rows = rows.where(F.size("x") == d)
    parts = 1 << max(0, min(MOST_PARTS.bit_length() - 1, (n // ROWS_A_PART).bit_length()))
    sample = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE_ROWS).toArrow()
    router, probes = learn(sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, d), parts, k, target_recall) if parts > 1 else (None, 1)
    layers = [w.astype(np.float32) for w in router.layers] if router else None

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, d)
            if layers is None:
                order = np.zeros((len(x), 1), np.int32)
            else:
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                order = np.argsort(-Router(layers).logits(unit), axis=1, kind="stable").astype(np.int32)
            asks = b["asks"].to_numpy(zero_copy_only=False)
            sent = [(o if a else o[:HOMES]).tolist() for o, a in zip(order, asks, strict=True)]
            salt = rng.integers(0, 1 << 62, len(x))  # rows of one part or one id are dealt over its blocks
            yield batch(vec_id=b["vec_id"], x=b["x"], asks=b["asks"], parts=pa.array(sent, pa.list_(pa.int32())), salt=pa.array(salt))

    rows = rows.withColumn("asks", F.coalesce("asks", F.lit(False)))
    indexed = scratch.keep(rows.mapInArrow(index, "vec_id long, x array<double>, asks boolean, parts array<int>, salt long"))
    base = indexed.select("vec_id", "x", F.explode(F.slice("parts", 1, HOMES)).alias("part"), "salt")
    asked = indexed.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("x", "parts")).alias("q")).select("query_id", "q.x", "q.parts")
    asked = scratch.keep(asked)
    block_rows = max(LEAST_BLOCK, BLOCK_BYTES // (8 * d))
    blocks = base.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # a row a part, MOST_PARTS at most

    def rerank(queries: DataFrame) -> DataFrame:
        right = base.join(F.broadcast(blocks), "part").select("part", F.pmod("salt", "blocks").cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "x")
        left = queries.join(F.broadcast(blocks), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("vec_id"), "x")
        met = right.unionByName(left).repartition("part", "block").sortWithinPartitions("part", "block", "asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, rows = None, [], []  # the rows of one block; its queries stream past them
            block: Block | None = None
            for b in batches:
                part, number, asks, vec_id = (b[c].to_numpy(zero_copy_only=False) for c in ("part", "block", "asks", "vec_id"))
                x = b["x"].flatten().to_numpy().reshape(-1, d)
                change = np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
                for i, j in zip([0, *change], [*change, len(part)], strict=True):
                    if i == j:
                        continue
                    if (part[i], number[i]) != key:
                        key, ids, rows, block = (part[i], number[i]), [], [], None
                    if not asks[i]:
                        ids.append(vec_id[i:j]), rows.append(x[i:j])
                        continue
                    if block is None and ids:
                        block, ids, rows = Block(np.concatenate(ids), np.concatenate(rows)), [], []
                    for m in range(i, j, QUERY_ROWS) if block else ():
                        some = slice(m, min(m + QUERY_ROWS, j))
                        query, near, score = block.nearest(vec_id[some], x[some], k)
                        yield batch(query_id=pa.array(query), vec_id=pa.array(near), score=pa.array(score))

        found = met.mapInArrow(tidy(run), "query_id long, vec_id long, score double")
        # at most k rows from each of a query's blocks
        ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id")
        top = ranked.agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("top"))
        return top.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.less")).alias("score"))

    first = scratch.keep(rerank(asked.select("query_id", "x", F.explode(F.slice("parts", 1, probes)).alias("part"))))
    if probes >= parts:
        scratch.drop(indexed, asked)
        return first
    short = first.groupBy("query_id").count().where(F.col("count") >= k)
    again = scratch.keep(asked.join(short, "query_id", "left_anti"))
    if again.isEmpty():
        scratch.drop(indexed, asked, again)
        return first
    rest = rerank(again.select("query_id", "x", F.explode("parts").alias("part")))
    return first.join(again.select("query_id"), "query_id", "left_anti").unionByName(rest)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
