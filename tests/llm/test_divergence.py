import re
from collections import Counter

import pytest
from tideline.llm import divergence

from .helpers import docs, empty

SCALE = 1_000_000_000


def brute(rows, least=10, top=10):
    """rows: text, lang, source. What the contract says, with Python's whole numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate({c: c + 32 for c in range(65, 91)}))) for t, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        mine = [(s, w) for x, s, w in found if x == lang]
        has = Counter(t for _, w in mine for t in set(w))
        kept = {t for t, n in has.items() if n >= least}
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(t for t in w if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c):
            return {t: 1 + SCALE * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        each, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s, mine_p in each.items():
            parts = {"pair": [(sum(f(mine_p[t], o[t]) for t in kept), x) for x, o in each.items() if x != s], "term": [(f(mine_p[t], q[t]), t) for t in kept if counts[s][t] and mine_p[t] > q[t]]}
            for part, items in parts.items():
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered[: top if part == "term" else None])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n long")


def many():
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["é", "Ähm", "中文", "straße"]
    rows = [(" ".join(words[(k * m) % 30] for m in range(1 + k % 23)) + (" 1a2B_c" if k % 4 else "") + " common" * (k % 5), "en" if k % 3 else "fr", f"s{k * k % 11}") for k in range(400)]
    rows += [("rare words here", "en", f"t{k}") for k in range(3)] + [("few", "de", "s1"), (None, "de", "s2"), ("", "de", None), (None, None, None), ("x" * 50_000, "en", "s1")]
    return rows + [("alpha beta " * 3, None, "s1")] * 12 + [("alpha gamma", None, None)] * 11


@pytest.mark.parametrize(("cells", "terms"), [(1 << 20, 300_000), (64, 5)])
def test_equals_brute_force(spark, monkeypatch, cells, terms):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HELD_TERMS", terms)
    for least, top in ((10, 10), (2, 3)):
        got = divergence.divergence(table(spark, many()).repartition(5), least, top)
        assert sorted(map(tuple, got.collect())) == brute(many(), least, top)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = [(n, total, v) for n in (0, 1, 10**12, 10**15 - 1) for total in (0, 10**15) for v in (1, 7, 10**9)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("*", divergence.frequency(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert all(r.p == 1 + SCALE * (r.n + 2) // (r.total + 2 * r.v) for r in got.collect() if r.n <= r.total)


def test_odd_and_empty_tables(spark):
    assert divergence.divergence(empty(spark)).count() == 0
    rows = [(r.text, r.lang, r.source) for r in docs(spark).collect()]
    assert sorted(map(tuple, divergence.divergence(docs(spark), 1).collect())) == brute(rows, 1)
