"""Toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 follow P(grade > k) = sigmoid(w.x - theta_k): one weight vector for all thresholds, and thresholds
that rise by construction (theta_0 and exponentials of steps). x holds the words of a text, each up to ``TIMES`` times, and
their first 4, 5 and 6 letters, hashed to 2^20 places. Weights are never negative and mostly zero (a proximal L1 step): no
amount of harmless text makes up for an insult. The score is the expected severity, sum_k P(grade > k).

Fit: on a bounded, documented sample of labelled documents (at most ``SAMPLE_ROWS`` by the smallest hashes of doc_id, and at most
``SAMPLE_BYTES`` of features; see ``training_rows``), on the driver. Labels
here only say toxic or not, so toxic rows are graded 1..3 by how many distinct marker terms they hold (terms that are far
commoner in toxic rows of the sample), in thirds; labels that hold grades already are used as they are.

Scoring: whole texts of all rows, one pass without a shuffle. A word's weight is a sum of four places, so a text's score is
a sum over its words.

Defined results: null and empty texts have no features and score as such; rows whose label is null are not learned from;
without labels of both kinds every score is 0; an empty table gives no rows; repeated rows are scored as they come; of rows that share a
labelled doc_id one is learned from; extra columns are passed through by ``reject`` and left out by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, hold, table, trim

SAMPLE_ROWS = 10_000
SAMPLE_BYTES, ROW_BYTES = 96 << 20, 4 << 20
PLACES = 1 << 20
PREFIXES = (4, 5, 6)
KEPT_TERMS = 30_000
TIMES = 3
LEAST_Z = 8.0
CUT = 0.15
WORD = re.compile(r"\w+")


def places(word: str) -> tuple[int, ...]:
    import xxhash

    return tuple(xxhash.xxh32_intdigest(x) % PLACES for x in (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)))


class Places(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = places(word)
        return value


class WordWeights(dict):
    """word -> the sum of its weights."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 250_000:
            self.clear()
        value = self[word] = float(sum(self.weights[p] for p in places(word)))
        return value


def counted(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def terms(texts: pd.Series) -> pd.Series:
    """The places of each text, as unsigned 32-bit bytes."""
    cache = Places()
    return pd.Series([np.fromiter((p for w, n in counted(t).items() for p in cache[w] * min(n, TIMES)), np.uint32).tobytes() for t in texts], dtype=object)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, total):
        """Expected severity for sums of weights."""
        total = np.asarray(total, float)
        return sigmoid(total[..., None] - self.thresholds).sum(-1) if len(self.thresholds) else np.zeros(total.shape)


def rising(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the steps behind it."""
    return free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def ordinal_gradients(w: np.ndarray, free: np.ndarray, flat: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradients by weights and by free threshold parameters; flat: weights that owner's rows use."""
    n, k, at = len(grades), len(free), np.arange(len(grades))
    eta = np.bincount(owner, w[flat], minlength=n)
    above = np.column_stack((np.ones(n), sigmoid(eta[:, None] - rising(free)), np.zeros(n)))
    slope = above * (1 - above)
    prob = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
    up, down = slope[at, grades] / prob, slope[at, grades + 1] / prob
    g_eta = -(up - down) / n
    g_theta = np.zeros(k)
    np.add.at(g_theta, grades[grades > 0] - 1, up[grades > 0] / n)
    np.add.at(g_theta, grades[grades < k], -down[grades < k] / n)
    g_free = np.concatenate(([g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(free[1:])))
    return float(-np.log(prob).mean()), np.bincount(flat, g_eta[owner], minlength=len(w)), g_free


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, l1: float = 2e-4, steps: int = 600, rate: float = 0.05) -> OrdinalModel:
    """Cumulative-link fit on rows of feature places; Adam steps followed by soft thresholding at and above zero."""
    k = int(grades.max(initial=0))
    if k == 0 or not (grades == 0).any():
        return OrdinalModel(np.zeros(PLACES, np.float32), np.zeros(0))
    size = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), size)
    # univariate screening: the places whose presence differs most between toxic and clean rows
    n1, n0 = (grades > 0).sum(), (grades == 0).sum()
    c1, c0 = (presence(rows, k) for k in (grades > 0, grades == 0))
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[c1 + c0 < 4] = 0
    least = max(3.0, LEAST_Z * (len(rows) / SAMPLE_ROWS) ** 0.5)  # z grows with the root of the sample
    chosen = np.flatnonzero(z >= max(least, np.partition(z, -KEPT_TERMS)[-KEPT_TERMS]))
    index = np.full(PLACES, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    ok = index[flat] >= 0
    flat, owner = index[flat[ok]], owner[ok]
    w, m, v = (np.zeros(len(chosen)) for _ in range(3))
    share = np.array([(grades > j).mean() for j in range(k)])
    theta = np.maximum.accumulate(np.log((1 - share) / np.maximum(share, 1e-6)) + 1e-3 * np.arange(k))
    free = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))  # theta_0 and log steps
    fm, fv = np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        g, g_free = ordinal_gradients(w, free, flat, owner, grades)[1:]
        for x, gx, mx, vx in ((w, g, m, v), (free, g_free, fm, fv)):
            mx += 0.1 * (gx - mx)
            vx += 0.001 * (gx * gx - vx)
            x -= rate * (mx / (1 - 0.9**t)) / (np.sqrt(vx / (1 - 0.999**t)) + 1e-8)
        w = np.maximum(w - rate * l1 * 20, 0)
    full = np.zeros(PLACES, np.float32)
    full[chosen] = w
    return OrdinalModel(full, rising(free))


def base(model: OrdinalModel) -> float:
    """The severity of a text without any evidence, which is the least there is."""
    return float(model.severity(np.zeros(1))[0])


def presence(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """In how many of the chosen rows each place is."""
    out = np.zeros(PLACES, np.int64)
    for r, c in zip(rows, chosen, strict=True):
        if c:
            out[np.unique(r)] += 1
    return out


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1..3 for toxic rows by thirds of their distinct marker terms."""
    if not toxic.any() or toxic.all():
        return toxic.astype(np.int64)
    c1, c0 = presence(rows, toxic) / toxic.sum(), presence(rows, ~toxic) / (~toxic).sum()
    marker = (c1 > 0.02) & (c1 > 10 * c0)
    hits = np.array([marker[np.unique(r)].sum() for r in rows])
    low, high = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (hits > low) + (hits > high), 0).astype(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, make: Callable[[pd.Series], pd.Series], rows: int, limit: int = SAMPLE_BYTES, row_limit: int = ROW_BYTES) -> pa.Table:
    """doc_id, label and features (binary) of labelled documents, sorted by doc_id, on the driver: bounded by rows and by bytes.

    labels: a row a doc_id. The ``rows`` smallest hashes of doc_id are chosen (a broadcast of proven size); of documents that share a
    doc_id the one with the smallest hash of its text, then the smallest text. Features of whole texts are written to the
    shared folder; only their sizes come here first. Documents with more than ``row_limit`` bytes of features are not learned from, nor are
    those after which the total, in the order of the hashes, would exceed ``limit``.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).alias("label")).withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(rows)
    found = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "at").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = scratch.keep(found.select("doc_id", "label", "at", F.pandas_udf(make, "binary")("t.text").alias("features")))
    sizes = found.select("at", "doc_id", F.octet_length("features").alias("size")).where(F.col("size") <= row_limit).orderBy("at", "doc_id").toArrow()  # numbers of at most ``rows`` rows
    n = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy(), dtype=np.int64), limit, side="right"))
    fits = F.octet_length("features") <= row_limit
    if n < len(sizes):
        at, doc_id = sizes["at"][n].as_py(), sizes["doc_id"][n].as_py()
        fits &= (F.col("at") < at) | ((F.col("at") == at) & (F.col("doc_id") < doc_id))
    got = found.where(fits).select("doc_id", "label", "features").toArrow().sort_by("doc_id")
    scratch.drop(found)
    return got


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    labels = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    got = training_rows(docs, labels, "toxic", terms, sample_rows)
    features = [np.frombuffer(x, np.uint32) for x in got["features"].to_pylist()]
    labels_ = got["label"].to_numpy().astype(np.int64)
    if len(labels_) == 0:
        return OrdinalModel(np.zeros(PLACES, np.float32), np.zeros(0))
    model = fit_ordinal(features, labels_ if labels_.max() > 1 else grade(features, labels_ > 0))
    del got, features
    trim()
    return model


def severity(text: Column, model: OrdinalModel) -> Column:
    used = np.flatnonzero(model.weights)
    values = model.weights[used]
    thresholds = model.thresholds
    state: dict[str, WordWeights] = {}

    def score(texts: pd.Series) -> pd.Series:
        if not state:
            hold(None)
            full = np.zeros(PLACES, np.float32)
            full[used] = values
            state["w"] = WordWeights(full)
        weight = state["w"].__getitem__
        sums = [sum([weight(w) * min(n, TIMES) for w, n in counted(t).items()]) for t in texts]
        return pd.Series(OrdinalModel(values, thresholds).severity(np.array(sums, float)), dtype="float64")

    return F.pandas_udf(score, "double")(text)


def reject_toxic(docs: DataFrame, model: OrdinalModel, cut: float = CUT) -> DataFrame:
    """The rows, with all their columns, whose expected severity is less than ``cut`` above that of a text without evidence."""
    return docs.where(severity(F.col("text"), model) < F.lit(base(model) + cut))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3) and toxic (1 where it is CUT or more above that of a text without evidence)."""
    docs = documents(table(spark, sf_dir, "documents"))
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", severity(F.col("text"), model).alias("severity"))
    return scored.withColumn("toxic", (F.col("severity") >= base(model) + CUT).cast("int"))
