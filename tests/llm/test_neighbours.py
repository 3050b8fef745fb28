import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import neighbours

DATA = "/root/testdata/check_s"
SCHEMA = "vec_id long, embedding array<float>, label int, part int, x string, parts string"


def rows(ids, x):
    return [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0, 1, "x", "p") for i, v in zip(ids, x, strict=True)]


def brute(ids, x, q, k=5):
    ids, x = np.asarray(ids), np.asarray(x, np.float32).astype(float)
    i = int(np.flatnonzero(ids == q)[0])
    s = x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
    ok = ids != q
    order = np.lexsort((ids[ok], -np.round(s[ok], 14)))[:k]
    return ids[ok][order].tolist(), s[ok][order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 16))
    ids = np.arange(3000)
    df = spark.createDataFrame(rows(ids, x), SCHEMA).repartition(4)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == 60
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        want, score = brute(ids, x, q)
        hits += len(set(want) & {f[1] for f in found})
        for _, v, s in found:
            a, b = (np.asarray(x[i], np.float32).astype(float) for i in (q, v))
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-14)
    assert hits / 300 >= 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_recall_on_a_table_larger_than_the_sample(spark, monkeypatch):
    """The query on vectors without clusters, with a sample of a third of them: recall against brute force, and fewer parts than half."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 3000)
    probes = []
    real = neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda *a: probes.append((a[1], real(*a)[1])) or real(*a))
    t = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toArrow()
    ids, x = t["vec_id"].to_numpy(), t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).astype(float)
    got = {}
    for r in neighbours.op10_neighbours(spark, DATA).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.flatnonzero(ids % 50 == 0)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -2
    best = ids[np.argsort(-score, axis=1)[:, :5]]
    assert set(got) == set(ids[asked]) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & set(b)) / 5 for q, b in zip(ids[asked], best, strict=True)]) >= 0.92
    assert probes[0][1] < probes[0][0] / 2


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 64)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 64)
    monkeypatch.setattr(neighbours, "CANDIDATES", 100)
    x = np.ones((500, 4))
    x[400:] = np.random.default_rng(1).normal(0, 1, (100, 4))
    df = spark.createDataFrame(rows(range(500), x), SCHEMA)
    found = [r.vec_id for r in neighbours.search(df, F.col("vec_id") == 50).orderBy("rank").collect()]
    assert found == [0, 1, 2, 3, 4]


def test_blocks_equal_a_scan(monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 3)).astype(float) + 0.125
    ids = rng.integers(0, 60, 90)  # repeated ids and tied vectors
    q = rng.integers(0, 90, 20)
    got = list(zip(*(c.tolist() for c in neighbours.Block(ids, x).nearest(ids[q], x[q], 4)), strict=True))
    want = []
    for i in q:
        score = np.einsum("nd,nd->n", np.broadcast_to(x[i], x.shape), x) / (np.sqrt(x[i] @ x[i]) * np.sqrt(np.einsum("nd,nd->n", x, x)))
        best = {}
        for j, s in zip(ids, score, strict=True):
            if j != ids[i]:
                best[j] = max(best.get(j, -9), s)
        want += [(ids[i], j) for j, s in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:4]]
    assert [g[:2] for g in got] == want


def test_odd_vectors(spark):
    bad = [None, [], [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3]]
    df = spark.createDataFrame(rows([1, 2, 3, 3, 4], [[1, 0], [1, 1], [0, 1], [0, 1], [-1, 0]]) + rows(range(10, 17), bad) + [(None, [1.0, 1.0], 0, 1, "", "")], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, F.col("vec_id").isin(1, 3, 10, 12)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 4), (3, 1, 2), (3, 2, 1), (3, 3, 4)]


def test_lengths_beyond_double_precision(spark):
    df = spark.createDataFrame(rows([1, 2, 3, 4], [[1, 0], [1, 1], [1e-200, 0], [1e200, 1e200]]), SCHEMA.replace("float", "double"))
    assert [(r.query_id, r.vec_id) for r in neighbours.search(df, F.lit(True)).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.search(df, F.col("vec_id") % 2 == 0).count() == 0
    lone = spark.createDataFrame(rows([2], [[1, 1]]), SCHEMA)
    assert neighbours.search(lone, F.col("vec_id") % 2 == 0).count() == 0


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (512, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = neighbours.knn(x, x, 6, True)
    part = neighbours.cut_graph(near, 8)
    assert (np.bincount(part) == 64).all()
    inside = (part[near] == part[:, None]).mean()
    assert inside > 2 * (63 / 511)  # far more neighbours inside than by chance
