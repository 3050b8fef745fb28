"""Importance resampling towards a target distribution, with partition-local word tries.

The features of a text are all runs of one to three consecutive words, hashed into ``BUCKETS`` buckets. A trie of the words that a
task is reading has a node for each distinct run: its count, and the CRC of its text, which is carried on from its parent's state by
the bytes of one more word. Only bucket totals leave a task; what they say of corpus and target gives each bucket a gain. Then the tries
are built again with gains at their nodes, and a document's weight is the sum along the paths of its words. Documents with enough words are
drawn by weight plus Gumbel noise, which is a draw without replacement in proportion to the weights' exponentials.

A trie holds ``SEGMENT_BYTES`` of text, so a task's memory has a bound; totals and weights are sums over its segments. A longer text
goes through several segments, each with the last two words of the one before, so no run is lost or counted twice.

Defined results: null and empty texts have no features and weight 0; equal rows are drawn one by one, in any order, for their ranks are
the same set; a null doc_id hashes as the empty string and loses every tie; an empty corpus gives no rows; an empty target gives gains from the
corpus alone; other columns are left out.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, small, table, tidy

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SEGMENT_BYTES = 2 << 20
SPACE = zlib.crc32(b" ")
#: Byte -> itself where it is part of a word (letters A-Z as a-z, digits, all of non-ASCII characters), else 0.
WORD_BYTE = np.array([b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b > 127 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def by_bits(columns: np.ndarray) -> np.ndarray:
    """The images of the 32 bits under a linear map -> its images of every value of each of the four bytes."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ columns[8 * byte + bit]
    return out


def mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0, x & 255] ^ tables[1, (x >> 8) & 255] ^ tables[2, (x >> 16) & 255] ^ tables[3, x >> 24]


@functools.lru_cache(1024)
def behind(n: int) -> np.ndarray:
    """What n more bytes do to a CRC state, apart from their own CRC: a linear map, as tables for its four bytes."""
    if n == 1:  # the CRC of a zero byte after a state, without what a zero byte gives by itself
        return by_bits(np.array([zlib.crc32(b"\0", 1 << k) ^ zlib.crc32(b"\0") for k in range(32)], np.uint32))
    half = behind(n // 2)
    columns = mapped(half, mapped(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    return by_bits(mapped(behind(1), columns) if n % 2 else columns)


@dataclass
class Level:
    """Nodes at one depth: the CRC of their text and their count; and the words where a run of this length begins, with its node."""

    state: np.ndarray
    count: np.ndarray
    at: np.ndarray
    node: np.ndarray


@dataclass
class Segment:
    """The bytes of some texts and where each begins; the first ``context`` words were counted before."""

    first: int
    data: np.ndarray
    begin: np.ndarray
    context: int = 0

    @functools.cached_property
    def words(self) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words, and the text that each belongs to."""
        data = WORD_BYTE[self.data]
        inside = data != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edge = self.begin[self.begin < len(data)]
        start[edge] |= inside[edge]  # texts lie next to each other
        at = np.flatnonzero(start)
        kept = data[inside]
        place = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(kept)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(place), pa.py_buffer(kept)])
        return words, np.searchsorted(self.begin, at, side="right") - 1


def trie(segment: Segment) -> list[Level]:
    """The levels of a segment's trie. A node is a parent with one word more; its state goes on from its parent's."""
    words, text = segment.words
    coded = words.dictionary_encode()
    word, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    spaced = np.array([zlib.crc32(w, SPACE) for w in known], np.uint32)
    size, lengths = pd.factorize(np.array([len(w) for w in known], np.int64))
    steps = np.stack([behind(int(n) + 1) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
    node, at, state = word, np.arange(len(word)), np.array([zlib.crc32(w) for w in known], np.uint32)
    levels = []
    for depth in range(1, LONGEST + 1):
        if depth > 1:
            go = at + depth - 1 < len(word)
            at, node = at[go], node[go]
            go = text[at] == text[at + depth - 1]
            at, node = at[go], node[go]
            many = max(1, len(known))
            node, paths = pd.factorize(node * many + word[at + depth - 1])
            parent, more = paths // many, paths % many
            before, by = state[parent], size[more]
            state = spaced[more]
            for byte in range(4):
                state = state ^ steps[by, byte, (before >> np.uint32(8 * byte)) & np.uint32(255)]
        new = at + depth > segment.context  # runs that end in the context were counted with it
        levels.append(Level(state, np.bincount(node[new], minlength=len(state)), at[new], node[new]))
    return levels


def segments(texts: pa.StringArray, limit: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """Texts next to each other, of so many bytes together; a longer one alone, in pieces that end where a word does."""
    place = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(place, place[i] + limit, side="right")) - 1)
        if place[j] - place[i] <= limit:
            yield Segment(i, data[place[i] : place[j]], place[i:j] - place[i])
        else:
            yield from pieces(i, data[place[i] : place[j]], limit)
        i = j


def pieces(i: int, data: np.ndarray, limit: int) -> Iterator[Segment]:
    carried, begin = np.zeros(0, np.uint8), 0
    context = 0
    while begin < len(data):
        end = min(begin + limit, len(data))
        while end < len(data) and WORD_BYTE[data[end]]:
            end += 1
        piece = Segment(i, np.concatenate((carried, data[begin:end])), np.zeros(1, np.int64), context)
        yield piece
        last = piece.words[0][-(LONGEST - 1) :].to_pylist()
        carried, context, begin = np.frombuffer(b"".join(w + b" " for w in last), np.uint8), len(last), end


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: the features of all texts (a column ``text``) in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in small(batches, 8192):
            for s in segments(b["text"]):
                for level in trie(s):
                    total += np.bincount(level.state % BUCKETS, weights=level.count, minlength=BUCKETS).astype(np.int64)
        there = np.flatnonzero(total)
        yield batch(bucket=pa.array(there, pa.int64()), n=pa.array(total[there], pa.int64()))

    found = texts.select("text").mapInArrow(tidy(run), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain in thousandths, from the bucket counts of corpus and target: ``BUCKETS`` rows, whatever the data."""
    (s, t) = (dict(x.collect()) for x in (corpus, target))
    held, wanted = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float(t.get(b, 0) + 1) * held / (float(s.get(b, 0) + 1) * wanted))) for b in range(BUCKETS)], np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 8192):
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for s in segments(b["text"]):
                text = s.words[1]
                for depth, level in enumerate(trie(s)):
                    many = len(s.begin)
                    there = np.bincount(text[level.at], minlength=many)
                    n_features[s.first : s.first + many] += there
                    if not depth:
                        n_words[s.first : s.first + many] += there
                    along = np.concatenate(([0], np.cumsum(gain[level.state % BUCKETS][level.node])))
                    ends = np.cumsum(there)
                    weight[s.first : s.first + many] += along[ends] - along[ends - there]
            yield batch(doc_id=b["doc_id"], n_words=pa.array(n_words), n_features=pa.array(n_features), weight=pa.array(weight))

    return texts.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for a doc_id everywhere."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Rows (doc_id, score, row) with their rank by score, then doc_id; null beyond ``percent`` of them.

    Ranges of scores are sorted, each by its own task; a row's rank is its place there behind the rows of the ranges before.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.keep(placed.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row a range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before.alias("before"), F.expr(f"{percent} * sum(size) OVER () div 100").alias("many"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(sizes, "part").withColumn("rank", F.when(rank <= F.col("many"), rank)).drop("part", "place", "before", "many")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of all documents; target is any table with a column ``text``.

    ``percent`` of the documents with at least ``least_words`` words are drawn and have a rank.
    """
    scratch = Scratch(docs.sparkSession)
    texts = documents(docs)
    gain = gains(bucket_counts(texts), bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text"))))
    scored = weighed(texts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= least_words
    out = ranked(scored.where(enough), scratch, percent).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A CRC takes the low half of each byte, then the high half, through a table of 16.
OP11_SQL = r"""
WITH
steps AS (SELECT list(v ORDER BY k) AS step FROM (SELECT k, list_reduce([k] || range(4), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM range(16) r(k))),
texts AS (SELECT 'd' AS part, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 'b', -row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT part, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT part, row_no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
grouped AS (SELECT part, row_no, f, count(*) AS n FROM runs GROUP BY ALL),
nibbles AS (SELECT f, list_transform(string_split(hex(encode(f)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS h FROM (SELECT DISTINCT f FROM grouped)),
crcs AS (SELECT f, xor(4294967295, list_reduce([4294967295] || list_transform(range(len(h)), lambda i: h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]::BIGINT),
    lambda c, x: xor(c // 16, step[xor(c % 16, x) + 1]))) % 10000 AS bucket FROM nibbles, steps),
counted AS (SELECT part, row_no, bucket, sum(n) AS n FROM grouped JOIN crcs USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (part = 'd'), 0) AS s, coalesce(sum(n) FILTER (part = 'b'), 0) AS t FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (part = 'b'), 0) + 1)::DOUBLE * (any_value(s) + 10000)::DOUBLE / ((coalesce(sum(n) FILTER (part = 'd'), 0) + 1)::DOUBLE * (any_value(t) + 10000)::DOUBLE))) AS gain FROM counted, totals GROUP BY bucket),
weights AS (SELECT row_no, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) GROUP BY row_no),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row_no) WHERE part = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed
"""
