"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from the form of its words (length, letter
case, digits, marks, hashed word shapes, repeats) to h = tanh(W x + b). Gated attention a = softmax(w . (tanh(V h) * sigmoid(U h)))
weighs the passages of a document, and the weighted sum z gives the score sigmoid(c . z + d). All of it is learned from
document labels alone, with the gradients written out in numpy.

Fit: on at most ``SAMPLE_ROWS`` labelled documents (the smallest hashes of doc_id) with at most ``ordinal.SAMPLE_BYTES`` of
passages (see ``ordinal.training_rows``) whose crc32 of doc_id as text has another
remainder by 4 than ``HELD_OUT``. Labels, lang, source and doc_id are no inputs of a score. Scoring: whole texts, one pass
without a shuffle.

Defined results: null and empty texts are one passage without words and get that passage's score; rows whose label is null
are not learned from; without labels of both kinds every score is the labels' mean (or 1); repeated rows are scored as they come;
an empty table gives no rows; extra columns are passed through by ``keep_good`` and left out by the query.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hold, table, trim
from .ordinal import sigmoid, training_rows

SAMPLE_ROWS = 12_000
PASSAGE = 64
SHAPES = 32
FORM = 12
WIDTH = FORM + SHAPES + 4
HELD_OUT = 2
CUT = 0.7
HIDDEN, GATE = 24, 12
LEAST_STEPS = 800


def form(word: str) -> np.ndarray:
    """What a word looks like; its letters do not matter."""
    out = np.zeros(FORM + SHAPES, np.float32)
    n = len(word)
    upper = sum(c.isupper() for c in word)
    digit = sum(c.isdigit() for c in word)
    alpha = sum(c.isalpha() for c in word)
    marks = n - digit - alpha
    vowel = sum(c in "aeiouyàâäáéèêëíîïóôöúùûüAEIOUY" for c in word)
    out[:FORM] = (
        min(n, 40) / 8, upper / n, digit / n, marks / n, upper == alpha > 1, marks > 1, alpha == 0, word[-1] in ".!?", word[-1] == ",",
        n > 20, vowel / n, word[0].isupper() and upper == 1,
    )
    shape = ""
    for c in word:
        kind = "U" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c
        if not shape.endswith(kind):
            shape += kind
    out[FORM + zlib.crc32(shape[:8].encode("utf-8", "surrogatepass")) % SHAPES] = 1
    return out


class Forms(dict):
    """word -> row of a growing table of forms, emptied between texts when it is full."""

    LIMIT = 100_000

    def __init__(self):
        self.table = np.zeros((1024, FORM + SHAPES), np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[k] = form(word)
        self[word] = k
        return k

    def passages(self, text: str) -> np.ndarray:
        """A row for each passage of the text: means over its words, and how much of it repeats."""
        words = text.split()
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        if len(self) > self.LIMIT:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = np.arange(0, len(at), PASSAGE)
        size = np.diff(np.append(starts, len(at))).astype(np.float32)
        out = np.empty((len(starts), WIDTH), np.float32)
        out[:, : FORM + SHAPES] = np.add.reduceat(self.table[at], starts, axis=0) / size[:, None]
        again = np.zeros((len(at), 2), np.float32)
        again[1:, 0] = at[1:] == at[:-1]
        again[2:, 1] = at[2:] == at[:-2]
        out[:, -4:-2] = np.add.reduceat(again, starts, axis=0) / size[:, None]
        out[:, -2] = len(set(words)) / len(words)
        out[:, -1] = np.log1p(len(words)) / 8
        return out


def encoded(texts: pd.Series) -> pd.Series:
    forms = Forms()
    return pd.Series([forms.passages(t or "").tobytes() for t in texts], dtype=object)


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        start = np.cumsum([0] + [len(b) for b in bags])[:-1]
        return sigmoid(forward((np.concatenate(bags) - self.mean) / self.scale, start, self.parts)["logit"])


def forward(x: np.ndarray, start: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    size = np.diff(np.append(start, len(x)))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
    a = e / np.repeat(np.add.reduceat(e, start), size)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "size": size, "logit": z @ p["c"] + p["d"][0]}


def mil_gradients(x: np.ndarray, start: np.ndarray, labels: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of bags (rows of x from each start) and its gradients by the parameters."""
    f = forward(x, start, p)
    own = np.repeat(np.arange(len(start)), f["size"])
    dl = (sigmoid(f["logit"]) - labels) / len(start)
    dz = dl[:, None] * p["c"]
    da = (dz[own] * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), f["size"]))
    dg = de[:, None] * p["w"]
    dt, ds = dg * f["g"] * (1 - f["t"] ** 2), dg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[own] + dt @ p["V"].T + ds @ p["U"].T
    du = dh * (1 - f["h"] ** 2)
    grad = {"W": x.T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dl, "d": np.array([dl.sum()])}
    return float((np.logaddexp(0, f["logit"]) - labels * f["logit"]).mean()), grad


def fit_mil(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, rate: float = 0.01, seed: int = 7) -> MilModel:
    labels = labels.astype(float)
    if len(labels) == 0 or labels.min() == labels.max():
        return MilModel(np.zeros(WIDTH), np.ones(WIDTH), {}, float(labels.mean()) if len(labels) else 1.0)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(0), np.maximum(every.std(0), 0.02)
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)), "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    parts = max(1, len(bags) // 256)
    epochs = max(epochs, -(-LEAST_STEPS // parts))  # small samples are gone through more often
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(bags)), parts):
            x = (np.concatenate([bags[i] for i in some]) - mean) / scale
            start = np.cumsum([0] + [len(bags[i]) for i in some])[:-1]
            grad = mil_gradients(x, start, labels[some], p)[1]
            t += 1
            for k in p:
                g = grad[k] + 1e-4 * p[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] -= rate * (0.2 if epoch >= epochs * 2 // 3 else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return MilModel(mean, scale, p)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> MilModel:
    labels = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    got = training_rows(docs, labels, "quality", encoded, sample_rows)
    model = fit_mil([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["features"].to_pylist()], got["label"].to_numpy())
    del got
    trim()
    return model


def quality(text: Column, model: MilModel) -> Column:
    state: dict[str, Forms] = {}

    def score(texts: pd.Series) -> pd.Series:
        if not state:
            hold(None)
            state["forms"] = Forms()
        forms = state["forms"]
        out, values = [], texts.tolist()
        for i in range(0, len(values), 64):
            out.append(model.score([forms.passages(t or "") for t in values[i : i + 64]]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return F.pandas_udf(score, "double")(text)


def keep_good(docs: DataFrame, model: MilModel, cut: float = CUT) -> DataFrame:
    """The rows, with all their columns, that score ``cut`` or more."""
    return docs.where(quality(F.col("text"), model) >= F.lit(cut))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
