"""Source divergence audit: how far the word frequencies of a language's sources lie apart, and which terms set a source off.

Terms that occur equally often in every source say the same about every pair of sources. So the terms of a language are grouped by their
vector of counts (source, count; zeros left out), each distinct vector is evaluated once, for every pair of sources that it tells
something about, and the result counts as often as there are terms with it. Where both counts are zero, a pair's value is the same for all
terms, and is added once for all of them. Terms are ranked last: a vector stands for its first terms only, as no others can be among
a source's first.

Frequencies are p = 1 + floor(SCALE (count + 2) / (N + 2 V)), and two of them are (p - q)^2 / (p + q) apart, rounded down, all in whole numbers.

Counts are summed within tasks, then over them; what a task holds is bounded by ``HELD_TERMS`` and ``CELLS``. A vector has one entry for each
source of its language at most, and the result one row for each pair of sources.

Defined results: null text, lang and source are empty strings; repeated rows are documents of their own; groups without terms take part with the
frequencies of unseen terms; where a language keeps no terms every pair is 0 apart; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, small, table, tidy

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
HELD_TERMS = 300_000
CELLS = 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte -> the letter a-z, or the byte of a non-ASCII character, that is part of a term; else a space.
TERM_BYTE = bytes(b if b > 127 or chr(b) in UPPER.lower() else b + 32 if chr(b) in UPPER else 32 for b in range(256))
#: The language's own row among its sources; no source's place.
WHOLE = -1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents with the term; a task gives its sums whenever it holds many.

    Every group has a row with a null term, whether or not its texts have any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        there: dict[tuple[str, str], Counter] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                has, k = there[lang, source], len(found) + 1
                terms = pa.array([None, *found], pa.binary()).cast(pa.string())
                yield batch(lang=pa.array([lang] * k), source=pa.array([source] * k), term=terms, n=pa.array([0, *found.values()], pa.int64()), docs=pa.array([0, *map(has.__getitem__, found)], pa.int64()))
            n.clear(), there.clear()

        for b in batches:
            for part in small(iter([b]), 4096):
                for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    key = lang, source
                    if key not in n:
                        n[key], there[key] = Counter(), Counter()
                    terms = text.translate(TERM_BYTE).split()
                    n[key].update(terms)
                    there[key].update(set(terms))
                if sum(map(len, n.values())) > HELD_TERMS:
                    yield from sums()
        yield from sums()

    empty = F.lit("")
    read = docs.select(F.coalesce("text", empty).alias("text"), F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"))
    found = read.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def frequency(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (n + 2 v)), exactly; null where nothing is kept."""
    wide = ((count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(30,0)")
    return F.call_function("div", wide, F.nullif(n + 2 * v, F.lit(0)).cast("decimal(19,0)")).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def evaluated(vectors: DataFrame) -> DataFrame:
    """lang, a, b, value, terms of distinct vectors (lang, terms, zero, places, p): sums over the terms that a or b has.

    zero: the frequency of an unseen term in each source of the language; places, p: the sources that have the terms, and their
    frequencies there. Each pair is evaluated once a vector, at the smaller place of those that have the term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, a), both in held.items():
                b = np.flatnonzero(both[1])
                yield batch(lang=pa.array([lang] * len(b), pa.string()), a=pa.array(np.full(len(b), a)), b=pa.array(b), value=pa.array(both[0][b]), terms=pa.array(both[1][b]))
            held.clear()

        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                mine = b.filter(pa.array(langs == lang))
                zero = mine["zero"][0].values.to_numpy()
                step = max(1, CELLS // len(zero))
                for i in range(0, mine.num_rows, step):
                    part = mine.slice(i, step)
                    sizes = np.diff(part["places"].offsets.to_numpy())
                    row, place = np.repeat(np.arange(part.num_rows), sizes), part["places"].flatten().to_numpy()
                    p, has = np.tile(zero, (part.num_rows, 1)), np.zeros((part.num_rows, len(zero)), bool)
                    p[row, place], has[row, place] = part["p"].flatten().to_numpy(), True
                    terms = part["terms"].to_numpy()
                    for a in np.unique(place).tolist():
                        with_a = np.flatnonzero(has[:, a])
                        mine_p, others = p[with_a, a][:, None], p[with_a]
                        other = ~has[with_a]
                        other[:, a + 1 :] = True
                        other[:, a] = False
                        times = other * terms[with_a][:, None]
                        if (lang, a) not in held:
                            held[lang, a] = np.zeros((2, len(zero)), np.int64)
                        held[lang, a] += np.stack([(times * ((mine_p - others) ** 2 // (mine_p + others))).sum(0), times.sum(0)])
                    if sum(x.size for x in held.values()) > CELLS:
                        yield from sums()
        yield from sums()

    found = vectors.mapInArrow(tidy(run), "lang string, a long, b long, value long, terms long")
    return found.groupBy(F.col("lang"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has a row for every other source, part ``term`` the ``top`` terms that a source has more of."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(term_counts(docs))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs).select("lang", "term", "n")
    kept = scratch.keep(kept)
    used = scratch.keep(counts.where("n > 0").join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(langs, "lang", "left").select("lang", "source", place.cast("int").alias("place"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")))
    groups = scratch.keep(groups.withColumn("zero", frequency(F.lit(0), F.col("total"), F.col("v"))))
    lists = groups.where("zero is not null").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "zero"))), lambda x: x.zero).alias("zero"))

    entry = F.struct("place", F.col("n").alias("count"))
    placed = used.join(groups.select("lang", "source", "place"), ["lang", "source"])
    vectors = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("vector"))
    nth = F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))
    vectors = scratch.keep(vectors)
    distinct = vectors.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("terms"))
    first = vectors.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("lang", "vector").agg(F.collect_list("term").alias("first"))
    distinct = scratch.keep(distinct.join(first, ["lang", "vector"]).withColumn("id", F.monotonically_increasing_id()))
    entries = distinct.select("lang", "id", "terms", "first", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["count"]).alias("lang_count"), F.inline("vector"))
    entries = entries.join(groups.drop("zero"), ["lang", "place"]).withColumn("p", frequency(F.col("count"), F.col("total"), F.col("v")))
    entries = scratch.keep(entries)

    sparse = entries.groupBy("lang", "id", "terms").agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("entries"))
    found = evaluated(sparse.join(lists, "lang").select("lang", "terms", "zero", F.col("entries.place").alias("places"), F.col("entries.p").alias("p")))
    left, right = (groups.select("lang", F.col("place").alias(c), F.col("source").alias(f"{c}_source"), F.col("zero").alias(f"{c}_zero"), "v") for c in ("a", "b"))
    pairs = left.join(right.drop("v"), "lang").where("a < b").join(found, ["lang", "a", "b"], "left")
    unseen = (F.col("v") - F.coalesce("terms", F.lit(0))) * apart(F.col("a_zero"), F.col("b_zero"))
    pairs = pairs.select("lang", "a_source", "b_source", F.coalesce(F.coalesce("value", F.lit(0)) + unseen, F.lit(0)).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = frequency(F.col("lang_count"), F.col("lang_total"), F.col("v"))
    terms = entries.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.explode("first").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH
texts AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
