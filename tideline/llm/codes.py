"""Token ids in directly addressable codes.

An id is cut into chunks, the lowest bits first. Level k holds the k-th chunk of every id that has one, at a fixed width, and a bit that
tells whether the id goes on in level k + 1. The rank of that bit, from a directory, is the id's place there. So the id at any position is
read from one place of each level, and nothing around it is decoded. Each file chooses the widths that make its own ids smallest.

A file holds whole documents in order of doc_id, up to ``FILE_TOKENS`` ids or one longer document::

    "TLCODES1"  crc32 and length of all that follows (2 x 8 bytes)  partition, file of the partition, documents, ids, levels (5 x 8 bytes)
    levels x (width, places; 2 x 8 bytes)
    documents x doc_id (8 bytes)   documents x end of its ids (8 bytes)   documents x whether it has a doc_id (bits)
    levels x (chunks (bits), going on (bits, but for the last level), ranks (directory of these))

All numbers are little-endian, bits begin at the lowest, each part is padded to 8 bytes. Files are written by Spark's text sink, whose commit
protocol keeps out what lost tasks leave, so each has one more line feed behind it. Beside them lies a manifest: file, documents, ids, and
how many ids the files before have.

Defined results: null text is empty and gives the end token alone; rows are in order of doc_id, null first, then of the texts' hashes; repeated
rows are documents of their own; an empty table gives a manifest without rows; other columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, batch, documents, hold, small, table, tidy
from .packing import BYTE_LETTER

MAGIC = b"TLCODES1"
HEAD = len(MAGIC) + 16
FILE_TOKENS = 4 << 20
END_ID = 2
CACHE_WORDS = 600_000
SLICE = 1 << 20
WORD_BITS, SUPER_BITS = 6, 16
#: Where the tokenizer parts white space: only the last character of a run, if it is a space, goes with what follows.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[\x1c-\x1f]")
MARKS = ",.;:!?"
#: Letters that are parted from what is no letter, and not among themselves.
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
LINES, LINE, BARE = "\x1d", "\x1e", "\x1f"


def padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def spread(width: int) -> list[tuple[int, int, int, int]]:
    """Where eight values of a width lie in ``width`` bytes: value, byte, and the shifts of the value up and down to that byte."""
    return [(i, j, i * width % 8, 8 * (j - i * width // 8)) for i in range(8) for j in range(i * width // 8, (i * width + width - 1) // 8 + 1)]


def pack(values: np.ndarray, width: int) -> bytes:
    """Values under 1 << width, one behind the other."""
    eight = np.zeros((-(-len(values) // 8), 8), np.uint64)
    eight.ravel()[: len(values)] = values
    out = np.zeros((len(eight), width), np.uint8)
    for i, j, up, down in spread(width):
        out[:, j] |= ((eight[:, i] << np.uint64(up)) >> np.uint64(down)).astype(np.uint8)
    return padded(out.tobytes()[: -(-len(values) * width // 8)])


def unpack(chunks: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """The chunks of this width from position first to last."""
    low, many = first // 8, -(-last // 8) - first // 8
    rows = np.zeros((many, width), np.uint8)
    there = chunks[low * width : (low + many) * width]
    rows.ravel()[: len(there)] = there
    eight = np.zeros((many, 8), np.uint64)
    for i, j, up, down in spread(width):
        eight[:, i] |= (rows[:, j].astype(np.uint64) << np.uint64(down)) >> np.uint64(up)
    return (eight & np.uint64((1 << width) - 1)).ravel()[first - 8 * low : last - 8 * low].astype(np.uint32)


def widths(ids: np.ndarray) -> list[int]:
    """The chunk widths that give these ids the fewest bits: a level costs its width, and a bit and a quarter where another follows."""
    length = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=33)
    longer = len(ids) - np.cumsum(length)  # ids with more than b bits
    top = max(1, int(np.flatnonzero(length).max())) if len(ids) else 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for b in range(top - 1, -1, -1):
        there = len(ids) if b == 0 else int(longer[b])
        best[b] = min((there * (w + (1.25 if b + w < top else 0)) + best[b + w][0], [w, *best[b + w][1]]) for w in range(1, top - b + 1))
    return best[0][1]


def ranks(bits: np.ndarray) -> bytes:
    """For 64-bit words of bits: ones before each 65 536 bits (8 bytes each), then ones before each word within them (2 bytes each)."""
    ones = np.bitwise_count(bits).astype(np.int64)
    before = np.cumsum(ones) - ones
    step = 1 << (SUPER_BITS - WORD_BITS)
    above = before[::step]
    return padded(above.astype("<i8").tobytes()) + padded((before - np.repeat(above, step)[: len(before)]).astype("<u2").tobytes())


def encode(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, part: int = 0, nth: int = 0) -> bytes:
    """A file of documents: their ids one after the other, and where each one's end."""
    chosen, levels, body = widths(ids), [], []
    left = ids
    for k, w in enumerate(chosen):
        body.append(pack(left & np.uint32((1 << w) - 1), w))
        levels.append((w, len(left)))
        left = left >> np.uint32(w) if w < 32 else np.zeros_like(left)
        if k + 1 < len(chosen):
            more = left > 0
            bits = np.frombuffer(padded(np.packbits(more, bitorder="little").tobytes()), "<u8")
            body += [bits.tobytes(), ranks(bits)]
            left = left[more]
    head = struct.pack("<5q", part, nth, len(doc_ids), len(ids), len(chosen)) + b"".join(struct.pack("<2q", *x) for x in levels)
    known = np.packbits(np.array([d is not None for d in doc_ids], bool), bitorder="little").tobytes()
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + ends.astype("<i8").tobytes() + padded(known)
    rest = head + docs + b"".join(body)
    return MAGIC + struct.pack("<2q", zlib.crc32(rest), len(rest)) + rest


class Codes:
    """A file, read at any position."""

    def __init__(self, content: bytes):
        crc, length = struct.unpack("<2q", content[len(MAGIC) : HEAD]) if content.startswith(MAGIC) else (-1, 0)
        if zlib.crc32(memoryview(content)[HEAD : HEAD + length]) != crc:
            raise ValueError("not a file of codes, or a damaged one")
        self.data = np.frombuffer(content, np.uint8)
        self.place = HEAD
        self.part, self.nth, self.n_docs, self.n_ids, n_levels = struct.unpack("<5q", self.take(40))
        sizes = [struct.unpack("<2q", self.take(16)) for _ in range(n_levels)]
        self.doc_ids = self.take(8 * self.n_docs).view("<i8")
        self.ends = self.take(8 * self.n_docs).view("<i8")
        self.known = np.unpackbits(self.take(-(-self.n_docs // 8)), bitorder="little")[: self.n_docs].astype(bool)
        self.levels = []
        for k, (width, many) in enumerate(sizes):
            chunks = self.take(-(-many * width // 8))
            more = None
            if k + 1 < n_levels:
                bits = self.take(8 * -(-many // 64)).view("<u8")
                above = self.take(8 * -(-many // (1 << SUPER_BITS))).view("<i8")
                within = self.take(2 * len(bits)).view("<u2")
                more = bits, above, within
            self.levels.append((width, chunks, more))

    def take(self, n: int) -> np.ndarray:
        """The next n bytes; their padding is stepped over."""
        out = self.data[self.place : self.place + n]
        self.place += n + -n % 8
        return out

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at positions, in any order."""
        positions = np.asarray(positions, np.int64)
        out = np.zeros(len(positions), np.uint32)
        if not len(positions):
            return out
        which, shift = slice(None), 0
        for width, chunks, more in self.levels:
            out[which] |= fetch(chunks, positions, width) << np.uint32(shift)
            if more is None:
                break
            on = (more[0][positions >> WORD_BITS] >> (positions & 63).astype(np.uint64)) & np.uint64(1) > 0
            which = np.flatnonzero(on) if isinstance(which, slice) else which[on]
            positions = rank(more, positions[on])
            shift += width
        return out

    def between(self, first: int, last: int) -> np.ndarray:
        """The ids from position first to last: on each level from the rank of the first to the rank of the last."""
        out, which, shift = np.zeros(last - first, np.uint32), slice(None), 0
        for width, chunks, more in self.levels:
            out[which] |= unpack(chunks, first, last, width) << np.uint32(shift)
            if more is None or first == last:
                break
            words = more[0][first >> WORD_BITS : (last - 1 >> WORD_BITS) + 1]
            on = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[first & 63 : (first & 63) + last - first])
            which = on if isinstance(which, slice) else which[on]
            first = int(rank(more, np.array([first]))[0])
            last = first + len(on)
            shift += width
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.between(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def rank(more: tuple[np.ndarray, np.ndarray, np.ndarray], positions: np.ndarray) -> np.ndarray:
    """The ones before each position."""
    bits, above, within = more
    word = positions >> WORD_BITS
    below = bits[word] & ((np.uint64(1) << (positions & 63).astype(np.uint64)) - np.uint64(1))
    return above[positions >> SUPER_BITS] + within[word] + np.bitwise_count(below)


def fetch(chunks: np.ndarray, positions: np.ndarray, width: int) -> np.ndarray:
    """The chunks of this width at positions: the bytes that each one touches, shifted and masked."""
    bit = positions * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    value = np.zeros(len(positions), np.uint64)
    last = len(chunks) - 1
    for k in range((width + 14) // 8):
        value |= chunks[np.minimum(byte + k, last)].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


class PieceIds(dict):
    """What lies between spaces -> its ids, with the space before it, as bytes, for a byte-level tokenizer that parts words there.

    BARE is before a piece that has no space before it, LINE and LINES stand for one or two line feeds on their own. None for what is or touches
    other white space: such texts are parted by ``SPACED``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.space = BYTE_LETTER[0x20]
        self.blank: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[LINE], self[LINES] = self.whole("\n"), self.whole("\n") * 2

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[piece] = self.make(piece)
        return value

    def make(self, piece: str) -> bytes | None:
        bare = piece[:1] == BARE
        word = piece[1:] if bare else piece
        if LETTERS.fullmatch(word):  # straight to the library's model
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTER)
            return as_bytes([t.id for t in self.model.tokenize(letters if bare else self.space + letters)])
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word[-1] in MARKS and LETTERS.fullmatch(word[-2:-1]):
            return self[piece[:-1]] + self[BARE + word[-1]]  # a letter and one mark behind it are parted in any case
        return self.whole(word if bare else " " + word)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        parted = f"{BARE}{text}".replace("\n\n", f" {LINES} {BARE}").replace("\n", f" {LINE} {BARE}") if "\n" in text else BARE + text
        try:
            return b"".join(map(self.__getitem__, parted.split(" ")))
        except TypeError:  # a piece without ids of its own
            return b"".join([self.blank_ids(p) if p.isspace() else self[p[1:] if p[0] == " " else BARE + p] for p in SPACED.findall(text)])

    def blank_ids(self, piece: str) -> bytes:
        """White space alone; only short runs are remembered."""
        if len(piece) > 64:
            return self.whole(piece)
        if piece not in self.blank:
            self.blank[piece] = self.whole(piece)
        return self.blank[piece]


def as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    if path not in _loaded:
        _loaded[path] = PieceIds(path)
    return _loaded[path]


def files(texts: DataFrame, tokenizer_path: str, end_id: int, file_tokens: int) -> DataFrame:
    """A row a file, from documents (doc_id, text) that are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_ids(tokenizer_path)
        hold(words)
        end, part, nth = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        doc_ids, ids, ends, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            content = encode(np.frombuffer(b"".join(ids), "<u4"), doc_ids, np.array(ends, np.int64), part, nth)
            return batch(content=pa.array([content], pa.binary()))

        for b in small(batches, 4096):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                found = words.ids(text) + end
                if n and n + len(found) // 4 > file_tokens:
                    yield closed()
                    nth += 1
                    doc_ids, ids, ends, n = [], [], [], 0
                doc_ids.append(doc_id), ids.append(found)
                n += len(found) // 4
                ends.append(n)
        if doc_ids:
            yield closed()

    return texts.mapInArrow(run, "content binary")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes all documents into files below ``folder`` and returns their manifest: file, n_docs, n_ids, start.

    Documents are dealt out in ranges of doc_id, each of which one task writes, file after file.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    texts = documents(docs).withColumn("row", F.monotonically_increasing_id())
    texts = texts.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    encoded = files(texts, tokenizer_path, end_id, file_tokens)
    encoded.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/codes")
    heads = stored(spark, folder).mapInArrow(tidy(head), "file string, part long, nth long, n_docs long, n_ids long")
    heads = Scratch(spark).keep(heads)
    heads = heads.withColumn("whole", F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")))
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    start = F.col("before") + F.col("whole") - F.col("n_ids")
    heads.join(parts, "part").select("file", "n_docs", "n_ids", start.alias("start")).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [struct.unpack("<4q", c.as_buffer()[HEAD : HEAD + 32]) for c in b["content"]]
        part, nth, n_docs, n_ids = (pa.array([r[k] for r in rows], pa.int64()) for k in range(4))
        yield batch(file=b["file"], part=part, nth=nth, n_docs=n_docs, n_ids=n_ids)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """file (its name) and content of the files; a task without documents leaves an empty one, which is left out."""
    found = spark.read.format("binaryFile").load(f"{folder}/codes").where("length > 0")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "content")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, n_docs long, n_ids long, start long").parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["file"].to_pylist(), b["content"], strict=True):
                codes = Codes(content.as_py())
                begins = np.concatenate(([0], codes.ends[:-1]))
                crcs, k = [], 0
                while k < codes.n_docs:
                    many = max(k + 1, int(np.searchsorted(codes.ends, begins[k] + SLICE, side="right")))
                    ids = codes.between(int(begins[k]), int(codes.ends[many - 1])).astype("<u4").tobytes()
                    crcs += [zlib.crc32(ids[4 * (i - begins[k]) : 4 * (j - begins[k])]) for i, j in zip(begins[k:many].tolist(), codes.ends[k:many].tolist(), strict=True)]
                    k = many
                doc_id = pa.array(codes.doc_ids, pa.int64(), mask=~codes.known)
                yield batch(file=pa.array([name] * codes.n_docs, pa.string()), doc_id=doc_id, within=pa.array(begins), n_tokens=pa.array(codes.ends - begins), ids_crc32=pa.array(crcs, pa.int64()))

    rows = stored(spark, folder).mapInArrow(tidy(run), "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(manifest(spark, folder).select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(positions: DataFrame, folder: str, step: int = FILE_TOKENS) -> DataFrame:
    """position, id: the ids at some positions (a column ``position``) of the whole corpus; positions behind its end are left out.

    A file is listed under each stretch of ``step`` ids that it touches, so a position finds it by equality. A file is read once
    for up to ``SLICE`` positions, of which none decodes another.
    """
    spark = positions.sparkSession
    listed = manifest(spark, folder).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("start") + F.col("n_ids") - 1) / step))))
    asked = positions.select(F.col("position").cast("long")).where("position >= 0").withColumn("stretch", F.floor(F.col("position") / step))
    found = asked.join(listed, "stretch").where("position >= start and position < start + n_ids").select("file", F.col("position") - F.col("start"), "start").toDF("file", "within", "start")
    nth = F.floor((F.row_number().over(Window.partitionBy("file").orderBy("within")) - 1) / SLICE)
    wanted = found.withColumn("nth", nth).groupBy("file", "start", "nth").agg(F.collect_list("within").alias("within"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, start, within in zip(b["content"], b["start"].to_pylist(), b["within"], strict=True):
                places = within.values.to_numpy()
                yield batch(position=pa.array(places + start), id=pa.array(Codes(content.as_py()).at(places).astype(np.int64)))

    return wanted.join(stored(spark, folder), "file").select("content", "start", "within").mapInArrow(tidy(run), "position long, id long")


def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).root
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, folder)
