import collections
import math
import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import ordinal, passages

from .helpers import docs, empty

DATA, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for k in range(n):
        t = [words[i] for i in rng.integers(0, 300, rng.integers(20, 200))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(rng.integers(2, 12)):
                t.insert(rng.integers(0, len(t)), rng.choice(["awfulbad", "nastymean", "rudefool", "vilescum"]))
        if not good:
            t = [w.upper() + "!!" for w in t]
        rows.append((k, " ".join(t)))
        marks.append((k, int(good), int(toxic)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = corpus(500, 1)
    model = ordinal.train_toxicity(docs(spark, rows), labels(spark, marks[:300]))
    assert (np.diff(model.thresholds) > 0).all() and 1 <= len(model.thresholds) <= 3
    df = docs(spark, rows)
    kept = ordinal.reject_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, t in marks if not t}


def test_severity_grows_with_what_is_said(spark):
    rows, marks = corpus(500, 2)
    model = ordinal.train_toxicity(docs(spark, rows), labels(spark, marks))
    few, many = ("word1 " * 20 + " ".join(w) for w in (["awfulbad"], ["awfulbad", "nastymean", "rudefool", "vilescum"]))
    out = docs(spark, [(1, few), (2, many), (3, None), (4, "")]).select("doc_id", ordinal.severity(F.col("text"), model).alias("s"))
    s = {r.doc_id: r.s for r in out.collect()}
    assert s[1] < s[2] and s[3] == s[4] < ordinal.CUT


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(800):
        g = int(rng.integers(0, 3))
        rows.append(np.unique(np.concatenate((rng.integers(0, 50, 5), 100 + rng.permutation(8)[: 2 * g])).astype(np.uint32)))
        grades.append(g)
    model = ordinal.fit_ordinal(rows, np.array(grades))
    got = model.severity(np.array([model.weights[r].sum() for r in rows]))
    means = [got[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


@pytest.mark.parametrize("marks", [[], [(1, 1, 0)], [(1, None, None), (None, 1, 1)]])
def test_without_both_kinds(spark, marks):
    df = docs(spark)
    model = ordinal.train_toxicity(df, labels(spark, marks))
    assert ordinal.reject_toxic(df, model).count() == df.count()
    q = passages.train_quality(df, labels(spark, marks))
    assert passages.keep_good(df, q).count() == df.count()


def test_quality(spark):
    rows, marks = corpus(500, 3)
    model = passages.train_quality(docs(spark, rows), labels(spark, marks[:350]))
    kept = passages.keep_good(docs(spark, rows), model)
    got, want = {r.doc_id for r in kept.collect()}, {k for k, good, _ in marks if good}
    assert len(got ^ want) <= 5
    odd = docs(spark)
    assert passages.keep_good(odd, model).columns == odd.columns
    scored = odd.select(passages.quality(odd.text, model).alias("s")).collect()
    assert len(scored) == odd.count() and all(0 <= r.s <= 1 for r in scored)
    assert passages.keep_good(empty(spark), model).count() == 0


def test_attention_finds_the_passage():
    """The fit finds the one passage that matters."""
    rng = np.random.default_rng(5)
    bags, y = [], []
    for _ in range(600):
        bag = rng.normal(0, 1, (rng.integers(2, 9), passages.WIDTH)).astype(np.float32)
        bag[:, 0] = 0
        bad = rng.random() < 0.5
        if bad:
            bag[rng.integers(0, len(bag)), 0] = 3
        bags.append(bag)
        y.append(1 - bad)
    model = passages.fit_mil(bags[:450], np.array(y[:450], float))
    assert ((model.score(bags[450:]) > 0.5) == np.array(y[450:])).mean() > 0.9
    z = [(b - model.mean) / model.scale for b in bags[:1]][0]
    f = passages.forward(z, np.array([0]), model.parts)
    assert f["a"].sum() == pytest.approx(1)


def test_held_out_rows_do_not_matter(spark):
    import zlib

    rows, marks = corpus(200, 6)
    held = {k for k, *_ in marks if zlib.crc32(str(k).encode()) % 4 == 2}
    flipped = [(k, 1 - q if k in held else q, t) for k, q, t in marks]
    a, b = (passages.train_quality(docs(spark, rows), labels(spark, m)) for m in (marks, flipped))
    assert all((a.parts[k] == b.parts[k]).all() for k in a.parts)


def slopes(f, x, step=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        old = x[i]
        x[i] = old + step
        high = f()
        x[i] = old - step
        out[i] = (high - f()) / (2 * step)
        x[i] = old
    return out


def test_attention_gradients_are_the_slopes():
    rng = np.random.default_rng(1)
    width, hidden, gate = passages.WIDTH, passages.HIDDEN, passages.GATE
    p = {"W": rng.normal(0, 0.2, (width, hidden)), "b": rng.normal(0, 0.2, hidden), "V": rng.normal(0, 0.5, (hidden, gate)), "U": rng.normal(0, 0.5, (hidden, gate)), "w": rng.normal(0, 0.5, gate), "c": rng.normal(0, 0.5, hidden), "d": rng.normal(0, 0.5, 1)}
    x, start, y = rng.normal(0, 1, (9, width)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    _, grad = passages.mil_gradients(x, start, y, p)
    for k in p:
        assert np.allclose(grad[k], slopes(lambda: passages.mil_gradients(x, start, y, p)[0], p[k]), atol=1e-7), k


def test_ordinal_gradients_are_the_slopes():
    rng = np.random.default_rng(2)
    w, free = rng.normal(0, 1, 6), np.array([-0.5, 0.1, -0.7])
    owner = np.sort(rng.integers(0, 12, 40))
    flat, grades = rng.integers(0, 6, 40), rng.integers(0, 4, 12)
    _, by_w, by_free = ordinal.ordinal_gradients(w, free, flat, owner, grades)
    loss = lambda: ordinal.ordinal_gradients(w, free, flat, owner, grades)[0]
    assert np.allclose(by_w, slopes(loss, w), atol=1e-7) and np.allclose(by_free, slopes(loss, free), atol=1e-7)


def test_training_rows_are_bounded_by_rows_and_bytes(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(k, "word " * k) for k in range(2, 60)] + [(99, "word " * 5000)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 100)], "doc_id long, toxic int")
    size = lambda texts: texts.map(lambda t: t.encode())
    every = ordinal.training_rows(docs(spark, rows), marks, "toxic", size, 1000)
    assert every["doc_id"].to_pylist() == [*range(1, 60), 99]
    assert len(ordinal.training_rows(docs(spark, rows), marks, "toxic", size, 10)) <= 10
    some = ordinal.training_rows(docs(spark, rows), marks, "toxic", size, 1000, limit=2000, row_limit=20_000)
    got = sum(len(x) for x in some["features"].to_pylist())
    assert 99 not in some["doc_id"].to_pylist() and 1500 < got <= 2000
    assert set(some["doc_id"].to_pylist()) < set(every["doc_id"].to_pylist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_on_labels_they_did_not_learn_from(spark, tmp_path):
    """Accuracy on rows without a part in the fit: op9 on its held-out rows, op5 with half of the labels taken away."""
    marks = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")
    got = passages.op9_quality(spark, DATA).toPandas().set_index("doc_id")
    assert got.columns.tolist() == ["held_out", "score", "predicted"] and got.score.between(0, 1).all()
    held = got[got.held_out].join(marks, how="inner")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.9
    learned, rest = marks[marks.index % 2 == 0], marks[marks.index % 2 == 1]
    os.symlink(f"{DATA}/documents.parquet", tmp_path / "documents.parquet")
    spark.createDataFrame(learned.reset_index()).write.parquet(str(tmp_path / "labels.parquet"))
    found = ordinal.op5_toxicity(spark, str(tmp_path)).toPandas().set_index("doc_id").join(rest, how="inner", rsuffix="_label")
    assert found[found.toxic_label == 1].toxic.mean() >= 0.75 and found[found.toxic_label == 0].toxic.mean() <= 0.03


def plain_severity(text, model):
    """The model by its definition: dense counts of places, one threshold after another."""
    x = np.zeros(ordinal.PLACES)
    for word, n in collections.Counter(re.findall(r"\w+", (text or "").lower())).items():
        for part in [word, *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)]:
            x[xxhash.xxh32_intdigest(part) % ordinal.PLACES] += min(n, 3)
    total = float(x @ model.weights.astype(float))
    return sum(1 / (1 + math.exp(-min(40, max(-40, total - t)))) for t in model.thresholds)


def plain_quality(text, model):
    """Passage by passage, word by word, with no arrays but the model's."""
    words = (text or "").split()
    rows = []
    for i in range(0, len(words), 64):
        part = range(i, min(i + 64, len(words)))
        mean = [float(np.mean([passages.form(words[k])[c] for k in part], dtype=np.float64)) for c in range(passages.FORM + passages.SHAPES)]
        again = [sum(k >= back and words[k] == words[k - back] for k in part) / len(part) for back in (1, 2)]
        rows.append([*mean, *again, len(set(words)) / len(words), math.log1p(len(words)) / 8])
    x = (np.array(rows or [[0.0] * passages.WIDTH]) - model.mean) / model.scale
    p = model.parts
    hidden = [[math.tanh(sum(r[i] * p["W"][i, j] for i in range(len(r))) + p["b"][j]) for j in range(passages.HIDDEN)] for r in x]
    logit = lambda v: 1 / (1 + math.exp(-v))
    scores = [sum(p["w"][k] * math.tanh(float(h @ p["V"][:, k])) * logit(float(h @ p["U"][:, k])) for k in range(passages.GATE)) for h in map(np.array, hidden)]
    shares = np.exp(np.array(scores) - max(scores))
    shares /= shares.sum()
    z = [sum(s * h[j] for s, h in zip(shares, hidden, strict=True)) for j in range(passages.HIDDEN)]
    return logit(sum(c * v for c, v in zip(p["c"], z, strict=True)) + p["d"][0])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_scores_equal_a_plain_scorer_on_whole_texts(spark):
    found, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, " \n "), (-3, "é 中文 😀 Idiot! " * 2000)], "doc_id long, text string")
    rows = found.select("doc_id", "text").unionByName(odd)
    toxic, good = ordinal.train_toxicity(found, labels), passages.train_quality(found, labels)
    assert len(toxic.thresholds) and good.parts
    got = rows.select("text", ordinal.severity(F.col("text"), toxic).alias("severity"), passages.quality(F.col("text"), good).alias("quality")).collect()
    assert len(got) == found.count() + 4
    for r in got:
        assert r.severity == pytest.approx(plain_severity(r.text, toxic), abs=1e-6)
        assert r.quality == pytest.approx(plain_quality(r.text, good), abs=1e-5)
