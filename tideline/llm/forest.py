r"""N-gram Jaccard join with a MinHash LSH forest.

Documents are sets of five-word shingles (lower-cased ``\w+`` words; a text of one to four words is one shingle). Texts with
equal sets are collapsed first. Every set gets a leaf in each of ``TREES`` prefix tries: ``DEPTH`` minima, 16 bits of each, the
first one in the highest bits, so that the order of leaves is the order of a trie. Equal leaves are collapsed, the others sorted
over all partitions, and the length of the prefix that two neighbours in that order share is all there is to know about the trie:
leaves under a node of depth d are neighbours that share d levels or more.

Prefixes are matched at full depth first. Sets under a node are linked to their first one or their neighbour, which makes
candidate groups of linear size, and every pair of a group is verified exactly, by blocks of about ``BLOCK`` sets with
intersections counted by matrix products. Each link tells how likely this depth was to miss one like it, and so the links found
tell the recall. While that is under ``target_recall``, matched prefixes are shortened by a level and pairs that were not in a
group before are verified. The depth at which even pairs at the threshold are missed no more often than that is the last.

No pairs are emitted: a block returns for each set how many links it has and the smallest set it is connected to.

Result: doc_id, class_id (smallest doc_id of the connected component of links), n_links (other texts with a Jaccard
similarity of at least the threshold, texts with equal shingles being one), n_copies (rows with the same shingles, itself included),
one row a row.

Defined results: null and empty texts and texts without words have no shingles and link to nothing; rows that share a
doc_id and a text are copies; rows that share only a doc_id are two texts, each with its own links and class; rows without doc_id
take no part; ties go to the smaller doc_id; other columns are left out. ``keep_one`` decides by doc_id and text: of each class
the row with the smallest (doc_id, shingles, text) stays, once (of rows alike in both, but not in other columns, any one).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHash, batch, by_bytes, documents, few_rows_of, in_one, mix, small, table, text_key, tidy
from .components import components

TREES, DEPTH = 32, 6
SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99999
BLOCK = 512
BLOCK_NAMES = 1 << 21  # names a side of a block, so that long texts make smaller blocks
FEW = 8
BITS = 16
WORD = re.compile(r"\w+")

_rng = np.random.default_rng(20_240_229)
FACTORS = (_rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
SHIFTS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)[:, None]
PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def missed(similarity, depth: int):
    """How likely it is that a pair shares a prefix of this depth in no tree."""
    return (1 - similarity**depth) ** TREES


def last_depth(threshold: float, target_recall: float) -> int:
    """The depth below which no prefix needs to be shortened: pairs at the threshold meet there with the target probability."""
    depth = DEPTH
    while depth > 1 and 1 - missed(threshold, depth) < target_recall:
        depth -= 1
    return depth


def shingles(text: str, words: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingle names of a whole text."""
    found = WORD.findall(text.lower())
    n = len(found)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    if n < SHINGLE:
        h = np.concatenate((h, np.full(SHINGLE - n, 1 + n, np.uint64)))
    out = h[: len(h) - SHINGLE + 1] * PLACE[0]
    for k in range(1, SHINGLE):
        out += h[k : len(h) - SHINGLE + 1 + k] * PLACE[k]
    return np.unique(mix(out))


def signature(names: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima, over the set in blocks that fit a cache."""
    x = (names >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512] * FACTORS
        h += SHIFTS
        np.minimum(out, h.min(axis=1), out=out)
    return out


def leaves(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of texts' signatures (texts x TREES x DEPTH) in two integers, whose order is that of (tree, first level, second level, ...)."""
    sig = (signatures & np.uint64((1 << BITS) - 1)).reshape(-1, TREES, DEPTH)
    high, low = np.tile(np.arange(TREES, dtype=np.uint64), (len(sig), 1)), np.zeros((len(sig), TREES), np.uint64)
    for k in range(DEPTH):
        if k < DEPTH // 2:
            high = high << np.uint64(BITS) | sig[:, :, k]
        else:
            low = low << np.uint64(BITS) | sig[:, :, k]
    return high.view(np.int64).ravel(), low.view(np.int64).ravel()


def shared_levels(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many levels each leaf shares with the one before it (the first leaf: none), -1 in another tree."""
    out = np.full(len(high), -1)
    h, x = high[1:] ^ high[:-1], low[1:] ^ low[:-1]
    half = DEPTH // 2
    for k in range(half + 1):
        out[1:][h >> (BITS * (half - k)) == 0] = k
    for k in range(1, DEPTH - half + 1):
        out[1:][(h == 0) & (x >> (BITS * (DEPTH - half - k)) == 0)] = half + k
    return out


def features(texts: DataFrame) -> DataFrame:
    """doc_id, text_key (digest of the text), shingle_key (128-bit digest of the set), size and leaves (one a tree)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in small(batches):
            keys, signatures, sizes = [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t, words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    signatures.append(signature(s))
            high, low = leaves(np.array(signatures, np.uint64))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(np.array(sizes) > 0, TREES, 0)))).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array(high), pa.array(low)], ["high", "low"])
            yield batch(doc_id=b["doc_id"], text_key=b["text_key"], shingle_key=pa.array(keys, pa.binary()), size=pa.array(sizes, pa.int64()), leaves=pa.ListArray.from_arrays(offsets, flat))

    keyed = texts.withColumn("text_key", text_key(F.col("text")))
    return keyed.mapInArrow(tidy(run), "doc_id long, text_key binary, shingle_key binary, size long, leaves array<struct<high:long,low:long>>")


def neighbours_in(trie: DataFrame, least: int) -> DataFrame:
    """trie: high, low, first (distinct leaves). a, b, depth: neighbouring leaves that share ``least`` levels or more.

    Leaves are sorted over all partitions. A partition's last leaf and the next one's first meet in a table of a row a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end, begin = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            high, low, first = (b[c].to_numpy() for c in ("high", "low", "first"))
            if end is None:
                begin = (high[0], low[0], first[0])
            else:
                high, low, first = (np.concatenate(([e], x)) for e, x in zip(end, (high, low, first), strict=True))
            depth = shared_levels(high, low)
            at = np.flatnonzero(depth >= least)
            end = (high[-1], low[-1], first[-1])
            none = pa.nulls(len(at), pa.int64())
            yield batch(a=pa.array(first[at - 1]), b=pa.array(first[at]), depth=pa.array(depth[at].astype(np.int32)), part=pa.nulls(len(at), pa.int32()), high=none, low=none, high2=none, low2=none)
        if end is not None:
            row = dict(a=begin[2], b=end[2], high=begin[0], low=begin[1], high2=end[0], low2=end[1])
            yield batch(**{c: pa.array([int(row[c])], pa.int64()) for c in ("a", "b")}, depth=pa.nulls(1, pa.int32()), part=pa.array([part], pa.int32()), **{c: pa.array([int(row[c])], pa.int64()) for c in ("high", "low", "high2", "low2")})

    return trie.select("high", "low", "first").repartitionByRange("high", "low").sortWithinPartitions("high", "low").mapInArrow(run, "a long, b long, depth int, part int, high long, low long, high2 long, low2 long")


def across_partitions(ends: DataFrame, least: int) -> DataFrame:
    """a, b, depth of the last leaf of each partition and the first of the next: a row a partition."""
    order = Window.orderBy("part")
    pairs = ends.select("part", F.col("a").alias("b"), "high", "low", *(F.lag(c).over(order).alias(n) for c, n in (("b", "a"), ("high2", "before_high"), ("low2", "before_low"))))
    h, x, half = F.col("high").bitwiseXOR(F.col("before_high")), F.col("low").bitwiseXOR(F.col("before_low")), DEPTH // 2
    depth = F.lit(-1)
    for k in range(half + 1):
        depth = F.when(F.shiftright(h, BITS * (half - k)) == 0, k).otherwise(depth)
    for k in range(1, DEPTH - half + 1):
        depth = F.when((h == 0) & (F.shiftright(x, BITS * (DEPTH - half - k)) == 0), half + k).otherwise(depth)
    return pairs.where("a is not null").select("a", "b", depth.alias("depth")).where(F.col("depth") >= least)


def with_sets(rows: DataFrame, *keep: str) -> DataFrame:
    """Replaces text by its shingle names (binary), for rows whose text has the key they came with."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            for part in by_bytes(b, "text"):
                sets = [shingles(t, words) for t in part["text"].to_pylist()]
                same = pa.array([len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, part["shingle_key"].to_pylist(), strict=True)], pa.bool_())
                names = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c].filter(same) for c in keep), names.filter(same)], [*keep, "names"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(tidy(run), ", ".join(f"{c} {types[c]}" for c in keep) + ", names binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many names each two sets share (float32, exact up to 2^24)."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.append(start, len(flat)))
    for k in range(2, FEW + 1):  # rare names: their few pairs are counted one by one
        who = owner[start[count == k][:, None] + np.arange(k)]
        for a in range(k):
            for b in range(a + 1, k):
                np.add.at(out, (who[:, a], who[:, b]), 1)
    out += out.T
    often = np.flatnonzero(count > FEW)
    for i in range(0, len(often), 2048):
        some = often[i : i + 2048]
        column = np.repeat(np.arange(len(some)), count[some])
        at = np.concatenate([np.arange(start[s], start[s] + count[s]) for s in some])
        dense = np.zeros((m, len(some)), np.float32)
        dense[owner[at], column] = 1
        out += dense @ dense.T
    return out


def links_of(node: np.ndarray, side: np.ndarray, group: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool, depths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of a block: its links, the smallest node it is connected to, and how many links like its own each depth misses.

    Pairs of one group of an earlier depth were verified there.
    """
    size = np.array([len(s) for s in sets], float)
    both = intersections(sets)
    either = size[:, None] + size - both
    linked = both >= threshold * either - 1e-6
    if across:
        linked &= side[:, None] != side
    linked &= group[:, None] != group
    root = node.copy()
    while True:
        new = np.minimum(root, np.where(linked, root, np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    a, b = np.nonzero(linked)
    similar = both[a, b] / either[a, b]
    lost = np.zeros((len(node), len(depths)))
    for k, d in enumerate(depths):
        p = missed(similar, d)
        lost[:, k] = np.bincount(a, p / (1 - p), minlength=len(node))
    return linked.sum(axis=1), root, lost


def verify(blocks: DataFrame, threshold: float, depths: list[int]) -> DataFrame:
    """blocks: comp, i, j, side, node, old, names; sorted by (comp, i, j, node) within partitions. Repeated rows of a node count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, side, old, sets = None, [], [], [], []

        def done() -> pa.RecordBatch | None:
            if len(node) < 2:
                return None
            count, root, lost = links_of(np.array(node), np.array(side), np.array(old), sets, threshold, key[1] != key[2], depths)
            some = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * len(depths) + 1, len(depths)).astype(np.int32)), pa.array(lost[some].ravel()))
            return batch(node=pa.array(np.array(node)[some]), root=pa.array(root[some]), links=pa.array(count[some].astype(np.int64)), lost=lists)

        for b in batches:
            for comp, i, j, s, n, o, names in zip(*(b[c].to_pylist() for c in ("comp", "i", "j", "side", "node", "old", "names")), strict=True):
                if (comp, i, j) != key:
                    out = done()
                    if out is not None:
                        yield out
                    key, node, side, old, sets = (comp, i, j), [], [], [], []
                if not node or node[-1] != n:
                    node.append(n), side.append(s), old.append(o), sets.append(np.frombuffer(names, np.uint64))
        out = done()
        if out is not None:
            yield out

    return blocks.mapInArrow(tidy(run), "node long, root long, links long, lost array<double>")


def with_roots(group: DataFrame) -> DataFrame:
    """node and root of every node, the roots themselves included."""
    return group.select("node", "root").unionByName(group.select(F.col("root").alias("node"), "root").distinct())


def links_at(edges: DataFrame, before: DataFrame | None, reps: DataFrame, texts: DataFrame, threshold: float, depths: list[int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The candidate groups (node, root) of edges, and the links (node, root, links, lost) between sets that were in no common group before."""
    spark = edges.sparkSession
    group = scratch.keep(with_roots(components(edges, scratch)))
    placed = group.withColumnRenamed("root", "comp").join(reps.select("node", "shingle_key", "first_id", "size"), "node")
    if before is not None:
        placed = placed.join(before.withColumnRenamed("root", "old"), "node", "left")
    placed = scratch.keep(placed.withColumn("old", F.coalesce("old", "node") if before is not None else F.col("node")))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_NAMES)).cast("int")
    size = placed.groupBy("comp").agg(blocks.alias("blocks"), F.min("old").alias("a"), F.max("old").alias("b")).where("a < b").select("comp", "blocks")
    chosen = placed.join(size, "comp").withColumn("side", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    chosen = scratch.keep(chosen.select("comp", "blocks", "side", "node", "old", "shingle_key", F.col("first_id").alias("doc_id")))
    sets = with_sets(chosen.where("blocks > 0").join(texts, "doc_id").dropDuplicates(["doc_id", "node", "text"]), "comp", "blocks", "side", "node", "old")
    each = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("comp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "old", "names")
    with few_rows_of(spark):
        links = scratch.keep(verify(each.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node"), threshold, depths))
    scratch.drop(placed, chosen)
    return group, links


def classified(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, text_key, shingle_key, root, class_id, n_links and n_copies of every row with a doc_id; root is null without shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = documents(docs).where(F.col("doc_id").isNotNull())
    found = scratch.keep(features(texts))
    reps = found.where(F.col("shingle_key").isNotNull()).groupBy("shingle_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("leaves").alias("leaves"))
    reps = scratch.keep(reps.withColumn("node", F.monotonically_increasing_id()))  # numbers of sets, once written
    under = reps.select("node", F.inline("leaves"))
    trie = scratch.keep(under.groupBy("high", "low").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    last = last_depth(threshold, target_recall)
    depths = list(range(last, DEPTH + 1))
    near = scratch.keep(neighbours_in(trie, last))
    same = under.join(trie.where("n > 1").drop("n"), ["high", "low"]).where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"), F.lit(DEPTH).alias("depth"))
    with few_rows_of(spark):
        edges = scratch.keep(same.unionByName(near.where("part is null").select("a", "b", "depth")).unionByName(across_partitions(near.where("part is not null"), last)))
    scratch.drop(trie, near)
    links, before = [], None
    for depth in reversed(depths):
        shorter = before
        before, new = links_at(edges.where(F.col("depth") >= depth), before, reps, texts, threshold, depths, scratch)
        links.append(new)
        if shorter is not None:
            scratch.drop(shorter)
        every = functools.reduce(DataFrame.unionByName, links)
        n, lost = every.agg(F.sum("links"), F.sum(F.col("lost")[depth - last])).first()
        if n and n / (n + lost) >= target_recall:
            break
    classes = scratch.keep(with_roots(components(every.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)))
    per_node = every.groupBy("node").agg(F.sum("links").alias("n_links")).join(classes, "node")
    ids = classes.join(reps.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_key = reps.select("shingle_key", "node", "n_copies", "first_id").join(per_node.join(ids, "root"), "node", "left")
    by_key = scratch.keep(by_key.select("shingle_key", "n_copies", "n_links", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first_id").alias("class_id")))
    scratch.drop(reps, edges, before, classes, *links)
    rows = found.select("doc_id", "text_key", "shingle_key").join(by_key, "shingle_key", "left")
    return rows.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0)), "n_copies": F.coalesce("n_copies", F.lit(1))})


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row."""
    return classified(docs, threshold, target_recall).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that stay: one of each class, those without shingles once a doc_id and text, all without doc_id."""
    rows = classified(docs)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "shingle_key", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    bare = rows.where("root is null").select("doc_id", "text_key").distinct()
    stay = first.unionByName(bare)
    keyed = in_one(docs.where(F.col("doc_id").isNotNull()), doc_id=F.col("doc_id").cast("long"), text_key=text_key(F.col("text")))
    kept = keyed.join(stay, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
