"""Substring dedup: words in repeated windows of ``WINDOW`` words, found by recompression.

1. Each text is parsed by rounds that name runs and pairs (``recompress``). Every window has an anchor: a symbol that the
   window's own words settle, so copies of the window have the same anchor in the same place. Neighbouring windows
   share anchors, about one for seven words. The anchor's name with the ten words before or behind it, whichever the
   window holds, is the window's key.
2. Texts with equal words are collapsed to the first one. Keys that occur once cannot be repeats; they end here.
3. For the other keys, the stretch of windows that share a key is named as a whole. Equal stretches hold equal
   windows, so all but the first are repeats; where a key has several stretches, their first ones are compared
   window by window. That names every repeat and the place of its first occurrence.
4. Names are not trusted: the words of first occurrences are fetched in spans, each once, and a repeat counts if its own words
   are the same, word by word.
5. The words that repeats cover go; texts without repeats are left alone.

Grouping is by pre-aggregated minima, marking by joins with one row a key, so a passage that a third of all documents
share makes no large task. What is collected per document is bounded by the document.

Defined results: null and empty texts have no words; rows that share doc_id and words are none earlier than the other;
rows without doc_id are left alone; texts under ``WINDOW`` words have no windows; an empty table gives no rows; other
columns are left out by ``find_repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch, by_size, documents, few_rows_of, in_one, mix, small, table, text_key, tidy
from .recompress import B, anchors, levels, stretch_names

WINDOW = 20
HALF = 10
SPAN = 64
CHUNK_BYTES = 400_000
MARK_BYTES = 400  # a mark as Python objects
FACTORS = np.random.default_rng(20_240_301).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass
class Group:
    """Texts of about CHUNK_BYTES together: their words joined by a space, and per word its name, text and place there."""

    plain: list[bytes]
    name: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    at: np.ndarray
    length: np.ndarray

    @functools.cached_property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size


def grouped(texts: list[bytes]) -> Group:
    """Names words by a sum of their bytes with a factor for each place: equal words have equal names everywhere, without a dictionary."""
    plain = [b" ".join(t.split()) for t in texts]  # bytes split at the six characters that part words
    length = np.array([len(p) for p in plain], np.int64)
    data = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    long = ends > starts  # texts without words leave a space
    starts, ends = starts[long], ends[long]
    size = ends - starts
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = data[np.repeat(starts, size) + inner].astype(np.uint64) + np.uint64(1)
    value *= FACTORS[inner & 4095]
    if len(size) and int(size.max()) > 4096:
        value *= FACTORS[(inner >> 12) & 4095]
    name = mix(np.add.reduceat(value, np.cumsum(size) - size)) if len(size) else np.zeros(0, np.uint64)
    first = np.cumsum(length + 1) - length - 1
    doc = np.searchsorted(first, starts, side="right") - 1
    return Group(plain, name, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64), starts - first[doc], size)


def parsed(g: Group) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one key: text, first window, number of windows, key, name; and the names of all windows."""
    n, doc, name = len(g.name), g.doc, g.name
    whole = np.arange(n) + WINDOW <= (g.begin + g.size)[doc] if n else np.zeros(0, bool)
    w = np.flatnonzero(whole)
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    anchor, at = anchors(levels(name, doc), WINDOW, whole)
    ten, twenty = stretch_names(name)
    pos = at[w]
    left = pos - w >= HALF
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (doc[w[1:]] != doc[w[:-1]]) | (pos[1:] != pos[:-1]) | (left[1:] != left[:-1]) | (anchor[w[1:]] != anchor[w[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(w)))
    key = mix(anchor[w[first]] + B * ten[np.where(left[first], pos[first] - HALF, pos[first])] + left[first])
    nth = np.arange(len(w)) - np.repeat(first, count)
    stretch = np.add.reduceat(mix(twenty[w] + nth.astype(np.uint64) * B), first)
    row = doc[w[first]]
    return row, w[first] - g.begin[row], count, key.view(np.int64), stretch.view(np.int64), twenty


def raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def groups(texts: list[bytes]) -> Iterator[tuple[int, Group]]:
    """Texts in groups of about CHUNK_BYTES, with the index of the first."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK_BYTES or i == len(texts) - 1:
            yield begin, grouped(texts[begin : i + 1])
            begin, n = i + 1, 0


def digest_of(plain: bytes) -> bytes:
    return hashlib.blake2b(plain, digest_size=16).digest()


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest (null without words), n_words, sha256 (of all words joined by a space) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for begin, g in groups(raw(b["text"])):
                row, _, _, key, _, _ = parsed(g)
                offsets = pa.array(np.searchsorted(row, np.arange(len(g.plain) + 1)).astype(np.int32))
                yield batch(
                    doc_id=b["doc_id"].slice(begin, len(g.plain)), text_key=b["text_key"].slice(begin, len(g.plain)), digest=pa.array([digest_of(p) if p else None for p in g.plain], pa.binary()), n_words=pa.array(g.size),
                    sha256=pa.array([hashlib.sha256(p).digest() for p in g.plain], pa.binary()), keys=pa.ListArray.from_arrays(offsets, pa.array(key)),
                )

    keyed = docs.withColumn("text_key", text_key(F.col("text")))
    return keyed.mapInArrow(tidy(run), "doc_id long, text_key binary, digest binary, n_words long, sha256 binary, keys array<long>")


def stretches(rows: DataFrame) -> DataFrame:
    """doc_id, digest, text with keys -> the stretches of those keys: array of key, stretch, at and window names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            wanted, digest = b["keys"], b["digest"].to_pylist()
            for begin, g in groups(raw(b["text"])):
                many = len(g.plain)
                row, at, count, key, stretch, twenty = parsed(g)
                ok = np.array([digest_of(p) == d for p, d in zip(g.plain, digest[begin : begin + many], strict=True)], bool)
                keep = np.isin(key, wanted.slice(begin, many).flatten().to_numpy()) & (ok[row] if len(row) else True)
                row, at, count, key, stretch = row[keep], at[keep], count[keep], key[keep], stretch[keep]
                ends = np.cumsum(count)
                index = np.repeat(g.begin[row] + at - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
                names = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(twenty[index].view(np.int64)))
                found = pa.StructArray.from_arrays([pa.array(key), pa.array(stretch), pa.array(at.astype(np.int32)), names], ["key", "stretch", "at", "names"])
                offsets = pa.array(np.searchsorted(row, np.arange(many + 1)).astype(np.int32))
                out = batch(doc_id=b["doc_id"].slice(begin, many), digest=b["digest"].slice(begin, many), text=b["text"].slice(begin, many), found=pa.ListArray.from_arrays(offsets, found))
                yield out.filter(pa.array(ok))

    return rows.mapInArrow(tidy(run), "doc_id long, digest binary, text string, found array<struct<key:long,stretch:long,at:int,names:array<long>>>")


def pieces(marked: DataFrame) -> DataFrame:
    """doc_id, digest and marks (at, n, lead_id, lead_digest, lead_at: windows alike by name) -> the same in pieces (n, span, skip, places at).

    Marks that continue each other on both sides become one, which is cut where the leading text's windows pass a multiple of ``SPAN``.
    Pieces of one place of the leading text, such as those of a line that repeats, are one row with all their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_size(whole, MARK_BYTES * pc.list_value_length(whole["marks"]).to_numpy())):
            out: dict[str, list] = {c: [] for c in ("doc_id", "digest", "at", "n", "lead_id", "lead_digest", "span", "skip")}
            for doc_id, digest, marks in zip(b["doc_id"].to_pylist(), b["digest"].to_pylist(), b["marks"].to_pylist(), strict=True):
                marks.sort(key=lambda m: (m["lead_id"], m["lead_digest"], m["at"] - m["lead_at"], m["at"]))
                line, low, high, segments = None, 0, 0, []
                for m in marks:
                    key, first, last = (m["lead_id"], m["lead_digest"], m["at"] - m["lead_at"]), m["lead_at"], m["lead_at"] + m["n"]
                    if key != line or first > high:
                        if line is not None:
                            segments.append((line, low, high))
                        line, low, high = key, first, last
                    else:
                        high = max(high, last)
                if line is not None:
                    segments.append((line, low, high))
                places: dict[tuple, list[int]] = {}
                for (lead_id, lead_digest, shift), first, last in segments:
                    while first < last:
                        span, skip = divmod(first, SPAN)
                        n = min(last, (span + 1) * SPAN) - first
                        places.setdefault((n, lead_id, lead_digest, span, skip), []).append(first + shift)
                        first += n
                for (n, lead_id, lead_digest, span, skip), at in places.items():
                    for c, v in zip(out, (doc_id, digest, at, n, lead_id, lead_digest, span, skip), strict=True):
                        out[c].append(v)
            types = {"doc_id": pa.int64(), "lead_id": pa.int64(), "digest": pa.binary(), "lead_digest": pa.binary(), "at": pa.list_(pa.int32())}
            yield batch(**{c: pa.array(v, types.get(c, pa.int32())) for c, v in out.items()})

    return marked.mapInArrow(tidy(run), "doc_id long, digest binary, at array<int>, n int, lead_id long, lead_digest binary, span int, skip int")


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, digest, text and spans -> a row a span with its words: those of ``SPAN`` windows, fewer at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids, digests, which, found = [], [], [], []
            for doc_id, digest, wanted, text in zip(b["doc_id"].to_pylist(), b["digest"].to_pylist(), b["spans"].to_pylist(), raw(b["text"]), strict=True):
                words = text.split()
                for k in wanted:
                    ids.append(doc_id), digests.append(digest), which.append(k), found.append(b" ".join(words[k * SPAN : (k + 1) * SPAN + WINDOW - 1]))
            yield batch(lead_id=pa.array(ids, pa.int64()), lead_digest=pa.array(digests, pa.binary()), span=pa.array(which, pa.int32()), words=pa.array(found, pa.binary()))

    return rows.mapInArrow(tidy(run), "lead_id long, lead_digest binary, span int, words binary")


def with_marks(b: pa.RecordBatch) -> np.ndarray:
    """The bytes of each row's text and of the words that its marks hold."""
    words = np.concatenate(([0], np.cumsum(pc.coalesce(pc.binary_length(b["marks"].values.field("words")), 0).to_numpy())))
    offsets = b["marks"].offsets.to_numpy()
    return pc.coalesce(pc.binary_length(b["text"]), 0).to_numpy() + words[offsets[1:]] - words[offsets[:-1]]


def cut(rows: DataFrame) -> DataFrame:
    """doc_id, digest, text and marks (places at, n, skip, words of the leading span) -> what is left of the text.

    A mark's windows are removed if their words are those of the leading text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_size(whole, with_marks(whole))):
            removed, left = [], []
            for text, marks in zip(raw(b["text"]), b["marks"].to_pylist(), strict=True):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                for m in marks:
                    size = m["n"] + WINDOW - 1
                    first = m["words"].split()[m["skip"] : m["skip"] + size]
                    for at in m["at"]:
                        if words[at : at + size] == first:
                            change[at] += 1
                            change[at + size] -= 1
                covered = np.cumsum(change)[:-1] > 0
                removed.append(int(covered.sum()))
                left.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]))
            yield batch(
                doc_id=b["doc_id"], digest=b["digest"], n_removed=pa.array(removed, pa.int64()),
                cut_sha256=pa.array([hashlib.sha256(t).digest() for t in left], pa.binary()), left=pa.array(left, pa.binary()).cast(pa.string()),
            )

    return rows.mapInArrow(tidy(run), "doc_id long, digest binary, n_removed long, cut_sha256 binary, left string")


def with_common(rows: DataFrame, again: DataFrame, total: int) -> DataFrame:
    """Rows whose key occurs again. again: key, count, of ``total`` occurrences in all.

    Keys that a thousandth of them or more share, so at most a thousand, meet their rows where they are, by a broadcast.
    """
    much = max(1024, total // 1000)
    hot = F.broadcast(again.where(F.col("count") > much).select("key"))
    rest = rows.join(hot, "key", "left_anti").join(again.where(F.col("count") <= much).select("key"), "key")
    return rows.join(hot, "key").unionByName(rest)


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256 and left (the kept words; null where nothing was removed), a row a document."""
    scratch = Scratch(docs.sparkSession)
    texts = documents(docs)
    base = scratch.keep(survey(texts))
    first = scratch.keep(base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    originals = base.where(f"n_words >= {WINDOW}").join(first, "digest").where("doc_id = first_id").select("doc_id", "digest", "keys")
    originals = scratch.keep(originals)
    again = scratch.keep(originals.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1"))
    wanted = originals.select("doc_id", "digest", F.explode("keys").alias("key"))
    wanted = with_common(wanted, again, int(again.agg(F.sum("count")).first()[0] or 0))
    with few_rows_of(docs.sparkSession):
        wanted = scratch.keep(wanted.groupBy("doc_id", "digest").agg(F.collect_list("key").alias("keys")))
        scratch.drop(originals, again)
        work = scratch.keep(stretches(texts.join(wanted.where("size(keys) > 0"), "doc_id")))
    rows = work.select("doc_id", "digest", F.inline("found"))
    leaders = rows.groupBy("key", "stretch").agg(F.min(F.struct("doc_id", "at", "digest", "names")).alias("f"))
    lead = {"lead_id": "doc_id", "lead_at": "at", "lead_digest": "digest", "names": "names"}
    leaders = scratch.keep(leaders.select("key", "stretch", *(F.col(f"f.{c}").alias(name) for name, c in lead.items())))
    narrow = rows.select("doc_id", "digest", "key", "stretch", "at", F.size("names").alias("n"))
    later = (F.col("doc_id") > F.col("lead_id")) | ((F.col("doc_id") == F.col("lead_id")) & (F.col("at") > F.col("lead_at")))
    mark = ["at", "n", "lead_id", "lead_digest", "lead_at"]
    whole = scratch.keep(narrow.join(leaders.drop("names"), ["key", "stretch"]).where(later).select("doc_id", "digest", *mark))
    contested = scratch.keep(leaders.groupBy("key").count().where("count > 1"))
    windows = with_common(leaders, contested, int(contested.agg(F.sum("count")).first()[0] or 0)).select("key", F.col("lead_id").alias("doc_id"), F.col("lead_digest").alias("digest"), "lead_at", F.posexplode("names").alias("k", "name"))
    windows = scratch.keep(windows.select("key", "name", "doc_id", "digest", (F.col("lead_at") + F.col("k")).alias("at")))
    least = windows.groupBy("key", "name").agg(F.min(F.struct("doc_id", "at", "digest")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    least = least.select("key", "name", F.col("f.doc_id").alias("lead_id"), F.col("f.at").alias("lead_at"), F.col("f.digest").alias("lead_digest"))
    single = windows.join(least, ["key", "name"]).where(later).select("doc_id", "digest", "at", F.lit(1).alias("n"), "lead_id", "lead_digest", "lead_at")
    marked = whole.unionByName(single).groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*mark)).alias("marks"))
    alike = scratch.keep(pieces(marked))
    scratch.drop(whole, windows, contested, leaders)
    asked = scratch.keep(alike.select(F.col("lead_id").alias("doc_id"), F.col("lead_digest").alias("digest"), "span").groupBy("doc_id", "digest").agg(F.collect_set("span").alias("spans")))
    texts_of = work.select("doc_id", "digest", "text")
    with few_rows_of(docs.sparkSession):
        words = scratch.keep(spans(texts_of.join(asked.where("size(spans) > 0"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])))
    marks = alike.join(words, ["lead_id", "lead_digest", "span"]).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("at", "n", "skip", "words")).alias("marks"))
    marks = scratch.keep(marks)
    scratch.drop(alike, asked, words)
    trimmed = scratch.keep(cut(work.select("doc_id", "digest", "text").join(marks, ["doc_id", "digest"])).dropDuplicates(["doc_id", "digest"]))
    scratch.drop(work, marks)
    rows = base.select("doc_id", "text_key", "digest", "n_words", "sha256").join(first, "digest", "left").join(trimmed, ["doc_id", "digest"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    return rows.select(
        "doc_id", "text_key", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.lower(F.hex(F.coalesce("cut_sha256", "sha256")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("left")).alias("left"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns; text is the kept words joined by a space where words were removed.

    Rows are known by doc_id and text, so rows that share only one of them are cut apart.
    """
    changed = find_repeats(docs).where("n_removed > 0").select("doc_id", "text_key", "left").distinct()
    keyed = in_one(docs, doc_id=F.col("doc_id").cast("long"), text_key=text_key(F.col("text")))
    cut = F.col("left").isNotNull()
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    old = [(c, F.col("row").getField(c)) for c in docs.columns]
    return keyed.join(changed, ["doc_id", "text_key"], "left").select(*(F.when(cut, new[c]).otherwise(was).alias(c) if c in new else was.alias(c) for c, was in old))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("left", "text_key")
