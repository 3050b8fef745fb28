import random
import re

import pytest

from tideline.llm import forest

from .helpers import docs, empty


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for k, t in rows:
        sets.setdefault(shingles(t), []).append(k)
    reps = {min(v): s for s, v in sets.items() if s}
    parent = {k: k for k, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = dict.fromkeys(reps, 0)
    for s, v in sets.items():
        for k in v if s else ():
            a, b = sorted((find(k), find(min(v))))
            parent[b] = a
    for i in reps:
        for j in reps:
            if i < j and len(reps[i] & reps[j]) / len(reps[i] | reps[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {k: (find(k), links[min(v)] if s else 0, len(v) if s else 1) for s, v in sets.items() for k in v}


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = []
    for k in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = near_copies(seed, 250)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in forest.join_similar(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_groups_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    rows = near_copies(3, 200)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in forest.join_similar(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_odd_documents(spark):
    got = forest.join_similar(docs(spark)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
    by = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got}
    assert by[1] == by[6] == (1, 0, 3)
    assert by[2] == (2, 0, 1) and by[3] == (3, 0, 1)
    kept = forest.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in [1, 2, 3, 4, 5, 8, 9, 10, None])


def test_empty_table(spark):
    assert forest.join_similar(empty(spark)).count() == 0
    assert forest.keep_one(empty(spark)).count() == 0


def test_the_last_depth_meets_the_target():
    assert forest.last_depth(0.8, 0.99999) == 5
    assert forest.last_depth(0.8, 0.5) == forest.DEPTH
    d = forest.last_depth(0.7, 0.9999)
    assert 1 - (1 - 0.7**d) ** forest.TREES >= 0.9999 > 1 - (1 - 0.7 ** (d + 1)) ** forest.TREES


def test_sorted_leaves_are_a_trie():
    import numpy as np

    rng = np.random.default_rng(1)
    sig = rng.integers(0, 3, (200, forest.TREES * forest.DEPTH)).astype(np.uint64) * np.uint64(7919)
    high, low = forest.leaves(sig)
    rows = sorted((int(h), int(x), k % forest.TREES, tuple(sig[k // forest.TREES].reshape(forest.TREES, -1)[k % forest.TREES])) for k, (h, x) in enumerate(zip(high, low)))
    assert [r[2:] for r in rows] == sorted(r[2:] for r in rows)
    got = forest.shared_levels(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    for k in range(1, len(rows)):
        (t, a), (u, b) = rows[k - 1][2:], rows[k][2:]
        assert got[k] == (-1 if t != u else next((d for d in range(forest.DEPTH) if a[d] != b[d]), forest.DEPTH))


def test_neighbours_over_partitions(spark):
    rows = [(h, x, 10 * h + x) for h in range(40) for x in range(5)]
    trie = spark.createDataFrame(rows, "high long, low long, first long")
    near = forest.neighbours_in(trie, 5).cache()
    assert near.where("part is not null").count() > 1
    got = near.where("part is null").select("a", "b", "depth").union(forest.across_partitions(near.where("part is not null"), 5))
    want = {(10 * h + x - 1, 10 * h + x, 5) for h in range(40) for x in range(1, 5)}
    assert {tuple(r) for r in got.collect()} == want


def test_prefixes_are_shortened_until_the_target(spark, monkeypatch):
    rows = near_copies(11, 120)
    used = []
    real = forest.links_at
    monkeypatch.setattr(forest, "links_at", lambda edges, *rest: used.append(1) or real(edges, *rest))
    forest.join_similar(docs(spark, rows), target_recall=0.5).count()
    easy = len(used)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in forest.join_similar(docs(spark, rows), target_recall=0.9999999).collect()}
    assert easy == 1 and len(used) - easy > 1
    assert got == brute(rows)


A, B = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3 + "one two three", "lambda mu nu xi omikron pi rho sigma tau ypsilon phi"
NEAR = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3 + "one two four"


def test_repeated_rows_are_one_text(spark):
    got = forest.join_similar(docs(spark, [(1, A), (1, A), (1, A.upper()), (2, NEAR)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == [(1, 1, 1, 3)] * 3 + [(2, 1, 1, 1)]


def test_rows_that_share_only_an_id(spark):
    rows = [(1, A), (1, B), (5, NEAR), (5, "a text that is like no other text in this table")]
    got = forest.join_similar(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 0), (1, 1, 1), (5, 1, 1), (5, 5, 0)]
    kept = {(r.doc_id, r.text) for r in forest.keep_one(docs(spark, rows + rows)).collect()}
    assert kept == {rows[0], rows[1], rows[3]}
    assert forest.keep_one(docs(spark, rows + rows)).count() == 3


def test_a_hub_of_many_edges(spark):
    from tideline.llm import components
    from tideline.llm.common import Scratch

    edges = spark.range(1, 5000).selectExpr("id AS a", "0L AS b").union(spark.range(6000, 6100).selectExpr("id AS a", "id - 1 AS b"))
    got = {r.node: r.root for r in components.components(edges, Scratch(spark)).collect()}
    assert got == dict.fromkeys(range(1, 5000), 0) | dict.fromkeys(range(6000, 6100), 5999)


def test_intersections(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 200, 60)).astype(np.uint64) for _ in range(30)]
    got = forest.intersections(sets)
    for i in range(30):
        for j in range(30):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_columns_named_like_helpers_come_back(spark):
    schema = "doc_id long, text string, row_doc_id string, kept_doc_id string, text_key string, row string, root int"
    rows = [(1, "one text", "a", "b", "c", "d", 5), (2, "one text", "e", "f", "g", "h", 6), (2, "two other words", "i", "j", "k", "l", 7), (None, "x", "m", "n", "o", "p", 8)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(str, forest.keep_one(df).collect())) == sorted(str(r) for r in df.collect() if r.root != 6)
