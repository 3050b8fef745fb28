"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens; a window is an output sequence. The queues are the leaves of a binary tree. Of the first
``n`` tokens that reach a node, ``round(n T_left / T)`` go left and the others right, so a node's deficit is at most half a token,
neither child's total ever falls, and a queue may have any share, also far under one token a window. What a queue has had
after ``m`` windows is that rounding from the root down to it, and the place of its k-th token is the inverse on the way up. That
closed form is the round-robin carried over all windows: any task can place any document without seeing another one,
which is how the deficits pass from partition to partition. By default the targets are the corpus's own token shares, the only
ones that hold in every window when each token is used exactly once; ``mixture`` gives others. Then queues run out at
different times; a node has one ratio up to each time when a queue below it runs out, and the others keep their proportions.

Steps: tokenise into a table in the shared folder, each row with its place in its partition's part of its source; sum the
tokens of (source, partition), small; place the documents. Every source is a queue, however many there are: sources are dealt by
hash into ``GROUPS`` groups, the driver builds the tree of the groups, and each group's tree of its own sources is built in a
task and kept in a table as each source's way down. Only sources that ``mixture`` names are in the driver's tree themselves, so
nothing the driver holds grows with the corpus.

Defined results: null text is empty and gives the end token alone; null source is ''; repeated rows and equal doc_ids are
packed as they come; an empty table gives no pieces; other columns are left out. Only the last sequence can be padded.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, hold, small, table

GROUPS = 4096
CACHE_WORDS = 800_000  # about 220 MB a Python worker
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Lower-case Latin letters, which the tokenizer's normaliser and splitter leave as they are.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\u012f\u0131-\u024f]+")
OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes follow from 256 on.
BYTE_LETTER = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in OWN)}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class WordIds(dict):
    """Word -> its ids as bytes, for a tokenizer that drops white space and never joins across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.most = CACHE_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value

    def make(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ",." and word[-2].isalpha():
            return self[word[:-1]] + self[word[-1]]  # letters and one mark behind them are split in any case
        low = word.lower()
        if LETTERS.fullmatch(low):  # straight to the library's model
            letters = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTER)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        # str.split() also splits at four control characters that are no white space to the tokenizer
        if SEPARATORS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii() and "<|" not in text:  # as the normaliser does; special tokens are matched before that
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))



_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, source, ids (unsigned 32-bit, little-endian), n, and base: the tokens before it in its partition's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        words.most = cache_words
        hold(words)
        end, part, served = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), {}
        for b in small(batches, 4096):
            ids = [words.ids(t) + end for t in b["text"].to_pylist()]
            source, n, base = b["source"].to_pylist(), [len(x) // 4 for x in ids], []
            for s, k in zip(source, n, strict=True):
                base.append(served.get(s, 0))
                served[s] = base[-1] + k
            yield batch(doc_id=b["doc_id"], source=b["source"], part=pa.array([part] * len(ids), pa.int64()), base=pa.array(base, pa.int64()), n=pa.array(n, pa.int64()), ids=pa.array(ids, pa.binary()))

    return documents(docs, F.coalesce(F.col("source"), F.lit("")).alias("source")).mapInArrow(run, "doc_id long, source string, part long, base long, n long, ids binary")


def share_of(x: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor((x * a + b) / c), exact for results under 2^51: the product may wrap, the remainder of a close guess does not."""
    guess = (x.astype(np.float64) * a / c).astype(np.int64)
    return guess + (x * a + b - guess * c) // c


@dataclass
class Schedule:
    """A binary tree whose leaves are the queues.

    Node i has the segments first[i] to first[i + 1]. Row 2 of ``start`` is what the node had before a segment, rows 0 and 1 what of
    that went left and right; ``dn`` and ``dl`` are what the node and its left child get within the segment. Row q of ``node`` and
    ``side`` (1: right) is the way from the root down to queue q, with -1 behind its end.
    """

    seq_len: int
    total: int
    first: np.ndarray
    start: np.ndarray
    dn: np.ndarray
    dl: np.ndarray
    node: np.ndarray
    side: np.ndarray


def counts(total: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens that queues have together when each has had ``weight * at`` or all it has."""
    out = np.zeros(len(at), np.int64)
    step = max(1, (1 << 20) // len(total))
    for i in range(0, len(at), step):
        v = at[None, i : i + step]
        had = np.minimum(np.floor(weight[:, None] * v), total[:, None]).astype(np.int64)
        out[i : i + step] = np.where(v >= (total / weight)[:, None], total[:, None], had).sum(axis=0)
    return out


def schedule(totals: list[int], seq_len: int, targets: list[float] | None = None) -> Schedule:
    """The tree of queues by their targets, heaviest next to the root; without targets, by their totals."""
    size = np.array(totals, np.int64)
    weight = np.array([t if t > 0 else 1e-12 for t in targets or totals], np.float64)
    # (weight, number, queues, left, right): each step joins the two lightest
    heap = [(weight[q], i, np.array([q]), None, None) for i, q in enumerate(np.flatnonzero(size).tolist())]
    heapq.heapify(heap)
    number, segments, ways, first = len(heap), [], [[] for _ in totals], [0]
    while len(heap) > 1:
        light, heavy = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (light[0] + heavy[0], number, np.concatenate((light[2], heavy[2])), light, heavy))
        number += 1
    open_ = [x for x in heap if x[3]]
    while open_:
        _, _, queues, left, right = open_.pop()
        for side, child in enumerate((left, right)):
            for q in child[2].tolist():
                ways[q].append((len(first) - 1, side))
            if child[3]:
                open_.append(child)
        at = np.unique(size[queues] / weight[queues])  # a queue runs out at each of them
        n, low = (np.concatenate(([0], sum(counts(size[c[2]], weight[c[2]], at) for c in part))) for part in ((left, right), (left,)))
        some = np.diff(n) > 0
        segments.append(np.stack([low[:-1], (n - low)[:-1], n[:-1], np.diff(n), np.diff(low)])[:, some])
        first.append(first[-1] + int(some.sum()))
    flat = np.concatenate(segments or [np.zeros((5, 0), np.int64)], axis=1)
    node, side = np.full((2, len(totals), max(map(len, ways), default=0)), -1, np.int64)
    for q, way in enumerate(ways):
        if way:
            node[q, : len(way)], side[q, : len(way)] = zip(*way, strict=True)
    return Schedule(seq_len, int(size.sum()), np.array(first, np.int64), flat[:3], flat[3], flat[4], node, side)


def segment(s: Schedule, node: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The last segment of each node that begins at ``key`` or before, as counted by that row of ``start``."""
    lo, hi = s.first[node], s.first[node + 1] - 1
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        fits = s.start[row, mid] <= key
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
    return lo


def position(s: Schedule, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of a queue's k-th token among all tokens: up the tree."""
    k = k.copy()
    for d in reversed(range(s.node.shape[1])):
        on = np.flatnonzero(s.node[queue, d] >= 0)
        side = s.side[queue[on], d]
        g = segment(s, s.node[queue[on], d], side, k[on])
        x, dn, half = k[on] - s.start[side, g], s.dn[g], s.dn[g] >> 1
        # left is round(n dl / dn), halves up; this is the least n behind which the child has more than x
        own = np.where(side == 1, dn - s.dl[g], s.dl[g])
        k[on] = s.start[2, g] + share_of(np.where(side == 1, x, x + 1), dn, own, np.where(side == 1, half, -half - 1))
    return k


def turn(s: Schedule, queue: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a queue has had before and after window k, and where its part of the window begins: down the tree."""
    before, after, offset = np.minimum(k * s.seq_len, s.total), np.minimum((k + 1) * s.seq_len, s.total), np.zeros(len(k), np.int64)
    for d in range(s.node.shape[1]):
        on = np.flatnonzero(s.node[queue, d] >= 0)
        node, right = s.node[queue[on], d], s.side[queue[on], d] == 1
        left = []
        for n in (before[on], after[on]):
            g = segment(s, node, np.full(len(on), 2), n)
            left.append(s.start[0, g] + share_of(n - s.start[2, g], s.dl[g], s.dn[g], s.dn[g] >> 1))
        offset[on] += np.where(right, left[1] - left[0], 0)
        before[on] = np.where(right, before[on] - left[0], left[0])
        after[on] = np.where(right, after[on] - left[1], left[1])
    return before, after, offset


def place(s: Schedule, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the token ranges [at, at + n) of queues: row, start in the row, length, sequence, offset."""
    row = np.flatnonzero(n > 0)
    first, last = (position(s, queue[row], x) // s.seq_len for x in (at[row], at[row] + n[row] - 1))
    sparse = n[row] < last - first + 1  # fewer tokens than windows: look at the tokens' windows only
    many = np.where(sparse, n[row], last - first + 1)
    r = np.repeat(np.arange(len(row)), many)
    j = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
    k, i = first[r] + j, row[r]
    by_token = np.flatnonzero(sparse[r])
    k[by_token] = position(s, queue[i[by_token]], at[i[by_token]] + j[by_token]) // s.seq_len
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
    i, k = i[new], k[new]
    before, after, offset = turn(s, queue[i], k)
    begin = np.maximum(at[i], before)
    size = np.minimum(at[i] + n[i], after) - begin
    ok = size > 0
    return i[ok], (begin - at[i])[ok], size[ok], k[ok], (offset + begin - before)[ok]


def beside(top: Schedule, low: Schedule) -> Schedule:
    """The queues of ``low``, which are below queue 0 of ``top``, and after them the other queues of ``top``."""
    upper, many, rest = int((top.node[0] >= 0).sum()), len(low.node), top.node[1:]
    wide = max(upper + low.node.shape[1], top.node.shape[1])
    node, side = np.full((2, many + len(rest), wide), -1, np.int64)
    node[:many, :upper], side[:many, :upper] = top.node[0, :upper], top.side[0, :upper]
    node[:many, upper : upper + low.node.shape[1]] = np.where(low.node >= 0, low.node + len(top.first) - 1, -1)
    side[:many, upper : upper + low.node.shape[1]] = low.side
    node[many:, : rest.shape[1]], side[many:, : rest.shape[1]] = rest, top.side[1:]
    join = lambda a, b: np.concatenate((a, b), axis=-1)
    return Schedule(top.seq_len, top.total, join(top.first, top.first[-1] + low.first[1:]), join(top.start, low.start), join(top.dn, low.dn), join(top.dl, low.dl), node, side)


def under(s: Schedule, queue: np.ndarray, lists: pa.ListArray) -> Schedule:
    """A tree with one queue a row: below queue ``queue[i]`` of ``s``, by the row's own way (tokens, tokens of the left child, side; from the top)."""
    begin, flat = lists.offsets.to_numpy().astype(np.int64) // 3, lists.values.to_numpy().reshape(-1, 3)
    depth, upper = np.diff(begin), (s.node[queue] >= 0).sum(axis=1)
    wide = int((upper + depth).max(initial=0))
    node, side = np.full((2, len(queue), wide), -1, np.int64)
    keep = min(wide, s.node.shape[1])
    node[:, :keep], side[:, :keep] = s.node[queue][:, :keep], s.side[queue][:, :keep]
    row = np.repeat(np.arange(len(queue)), depth)
    own = np.arange(begin[0], begin[-1])
    at = upper[row] + own - begin[row]
    node[row, at], side[row, at] = len(s.first) - 1 + own - begin[0], flat[own, 2]
    first = np.concatenate((s.first, s.first[-1] + 1 + np.arange(len(own))))
    start = np.concatenate((s.start, np.zeros((3, len(own)), np.int64)), axis=1)
    return Schedule(s.seq_len, s.total, first, start, np.concatenate((s.dn, flat[own, 0])), np.concatenate((s.dl, flat[own, 1])), node, side)


def ways(sources: DataFrame) -> DataFrame:
    """source, group, t -> source, group and the source's way down the tree of its group, as ``under`` reads it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("source")
        tree, out = schedule(t["t"].to_pylist(), 1), []
        for node, side in zip(tree.node, tree.side, strict=True):
            k = node >= 0
            g = tree.first[node[k]]  # without targets a node has one segment
            out.append(np.stack([tree.dn[g], tree.dl[g], side[k]], axis=1).ravel().tolist())
        return pa.table({"source": t["source"], "group": t["group"], "way": pa.array(out, pa.list_(pa.int64()))})

    return sources.groupBy("group").applyInArrow(run, "source string, group int, way array<long>")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, mixture: dict[str, float] | None = None, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row a piece, see PIECE; with_ids adds the piece's ids (binary), from which ``sequences`` builds the windows.

    ``mixture`` names sources with their target weights; sources that it does not name share the weight at ''.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokens = scratch.keep(tokenize(docs, tokenizer_path, end_id, cache_words), compression="snappy")
    blocks = scratch.keep(tokens.groupBy("source", "part").agg(F.sum("n").alias("t")))
    own = sorted(s for s in mixture or {} if s != "")
    group = F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int")
    if own:  # a named source is a group of its own
        named = spark.createDataFrame([(s, GROUPS + i) for i, s in enumerate(own)], "source string, own int")
        sources = blocks.groupBy("source").agg(F.sum("t").alias("t")).join(named, "source", "left").withColumn("group", F.coalesce("own", group)).drop("own")
    else:
        sources = blocks.groupBy("source").agg(F.sum("t").alias("t")).withColumn("group", group)
    sources = scratch.keep(sources)
    sums = {r[0]: int(r[1]) for r in sources.groupBy("group").agg(F.sum("t")).collect()}
    shared = [sums.get(g, 0) for g in range(GROUPS)]
    plan = schedule(shared, seq_len)
    if own:
        plan = beside(schedule([sum(shared), *(sums.get(GROUPS + i, 0) for i in range(len(own)))], seq_len, [float(mixture.get("", 0.0)), *(float(mixture[s]) for s in own)]), plan)
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("t").over(order), F.lit(0))).drop("t")
    starts = scratch.keep(starts.join(ways(sources), "source"))
    scratch.drop(blocks, sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048, "ids"):
            at, n = (b[c].to_numpy().astype(np.int64) for c in ("at", "n"))
            tree = under(plan, b["group"].to_numpy(), b["way"])
            row, start, size, seq, offset = place(tree, np.arange(len(n)), at, n)
            ids = [memoryview(x) for x in b["ids"].to_pylist()]
            cut = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            take = pa.array(row)
            out = {"doc_id": b["doc_id"].take(take), "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(seq), "offset": pa.array(offset), "source": b["source"].take(take)}
            yield batch(**out, **({"ids": pa.array([bytes(x) for x in cut], pa.binary())} if with_ids else {}))

    placed = tokens.join(starts, ["source", "part"]).select("doc_id", "source", "group", "way", (F.col("start") + F.col("base")).alias("at"), "n", "ids")
    return placed.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, seq_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids (binary, padded to seq_len unless its length is a power of two) of pieces with ids."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids))
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(seq_len) - F.col("n_tokens")).cast("int")))
    return rows.select("sequence_id", "n_tokens", F.when(F.bit_count("n_tokens") == 1, ids).otherwise(F.concat(ids, pad)).alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
