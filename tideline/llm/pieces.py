"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

One pass over the text walks the automaton; at every position its output links list the pieces that end there, and each is
relaxed against the best path to its start (Viterbi): the score of a path is the sum of its pieces' scores. For a unigram model
that gives the ids. A BPE model's scores are merge ranks, and the library's ids are not the path with the highest sum; there the
same pass also relaxes validity: a path is valid if every two neighbours stay apart when their joined text is merged by itself,
and exactly one piece that ends at a position continues a valid path. Both paths are returned. Pieces that their own text does
not merge to can never be output and are left out.

No piece holds the space mark behind another character, and characters outside the vocabulary join nothing. So a text
falls into independent chunks at spaces and line ends, and the ids of chunks are remembered up to a bound.

Defined results: null and empty texts have no ids; characters that no piece covers become byte pieces (or the unknown id
where the model has none); repeated rows are encoded as they come; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, documents, hold, small, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
PAIR_BITS = 20


class Arrays:
    """An Aho-Corasick automaton in arrays, for steps of many texts at once."""

    def __init__(self, pieces: dict[str, int]):
        chars = sorted({c for p in pieces for c in p})
        self.kind = np.zeros(0x110000, np.int64)  # of a character; 0: in no piece
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        number, after, piece, depth = {c: k for k, c in enumerate(chars, 1)}, [{}], [-1], [0]
        for text, i in pieces.items():
            node = 0
            for c in text:
                if number[c] not in after[node]:
                    after[node][number[c]] = len(after)
                    after.append({}), piece.append(-1), depth.append(depth[node] + 1)
                node = after[node][number[c]]
            piece[node] = i
        fail, output, link, queue = [0] * len(after), [0] * len(after), [0] * len(after), list(after[0].values())
        for node in queue:  # breadth first: what a node fails to is done before it
            link[node] = output[fail[node]]
            output[node] = node if piece[node] >= 0 else link[node]
            for k, child in after[node].items():
                f = fail[node]
                while f and k not in after[f]:
                    f = fail[f]
                fail[child] = after[f].get(k, 0)
                queue.append(child)
        self.fail, self.output, self.link, self.piece, self.depth = (np.array(x, np.int64) for x in (fail, output, link, piece, depth))
        self.single = np.zeros(self.kinds, bool)
        self.single[[number[t] for t in pieces if len(t) == 1]] = True
        keys = np.array([node * self.kinds + k for node, nexts in enumerate(after) for k in nexts])
        order = np.argsort(keys)
        self.keys, self.nexts = keys[order], np.array([child for nexts in after for child in nexts.values()])[order]

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(state), np.int64), np.flatnonzero(kind)
        state = state[todo]
        while len(todo):
            key = state * self.kinds + kind[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = self.nexts[at[hit]]
            more = ~hit & (state > 0)
            todo, state = todo[more], self.fail[state[more]]
        return out


class Pieces(dict):
    """A model's pieces, their automaton, and encoding of chunks of escaped text."""

    LIMIT = 300_000
    PAIRS = 250_000
    LONGEST, TOGETHER = 40, 8192

    def __init__(self, serialized: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(serialized)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models whose normaliser is the identity, with the space mark as a prefix, are handled")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces are not handled")
        self.kind, self.prefix = model.trainer_spec.model_type, spec.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are handled")
        self.piece = [p.piece for p in model.pieces]
        self.type = [p.type for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        byte_of = {i: bytes([b]).decode("ascii", "surrogateescape") for b, i in self.bytes.items()}
        self.text = [byte_of.get(i, " ⁇ " if i == self.unknown else "" if self.type[i] == CONTROL else p.replace(SPACE, " ")) for i, p in enumerate(self.piece)]
        self.apart: dict[int, bool] = {}
        self.old: dict[str, tuple[bytes, bytes, float]] = {}
        self.pair_key, self.pair_ok = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.low = min((self.score[i] for i in self.id.values()), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with a space mark behind other characters are not handled")
        self.size = [len(p) for p in self.piece]
        self.sizes, self.scores = np.array(self.size), np.array(self.score)
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.splits = "".join(c for c in "\n" if c not in self.id)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}{self.splits}]*|[{self.splits}]|[^{SPACE}{self.splits}]+" if self.splits else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        #: For BPE: order of merging (-1 for single characters), the two halves of the last merge, and whether halves always come before wholes.
        self.rank = [-1.0 if self.size[i] == 1 else -x for i, x in enumerate(self.score)]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.piece)
        self.plain = [True] * len(self.piece)
        self.automaton = ahocorasick.Automaton()
        for text, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            if self.kind == BPE and len(text) > 1:
                parts, cut = self.merge(text)
                if parts != [text]:
                    continue
                a, b = self.halves[i] = self.id[text[:cut]], self.id[text[cut:]]
                self.plain[i] = self.plain[a] and self.plain[b] and max(self.rank[a], self.rank[b]) < self.rank[i] and 2 * SPACE not in text
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.arrays = Arrays({t: i for t, i in self.id.items() if t in self.automaton})

    def usable(self, text: str) -> bool:
        """Whether a piece is in the automaton."""
        return text in self.automaton

    def merge(self, text: str) -> tuple[list[str], int]:
        """Pair merging by rank, leftmost first among equals: the definition of a BPE model, for short texts. And the length of the left part in the last merge."""
        parts, cut = list(text), 0
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                break
            k = best[1]
            cut = len(parts[k])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, cut

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives the two pieces back."""
        if not (self.plain[left] and self.plain[right]):
            a, b = self.piece[left], self.piece[right]
            return self.merge(a + b)[0] == [a, b]
        # Undo merges at the border, the latest first. Between two of them a merge across the border must not have come before
        # the earlier undone one; among equal ranks the one further left comes first.
        until, rank, halves = math.inf, self.rank, self.halves
        while True:
            across = self.id.get(self.piece[left] + self.piece[right])
            if across is not None and rank[across] < until:
                return False
            if rank[left] > rank[right]:
                until, left = rank[left], halves[left][1]
            elif rank[right] >= 0:
                until, right = rank[right] + 0.5, halves[right][0]
            else:
                return True

    def paths(self, text: str) -> tuple[list[int], list[int], float]:
        """The model's own path over a chunk, and the best one with its score: ids; below zero: -1 - position of a character that no piece covers.

        One pass of the automaton over the chunk; the pieces that its output links list at a position are relaxed for both. For a
        unigram model they are the same path.
        """
        n, bpe = len(text), self.kind == BPE
        last: list[int | None] = [None] * (n + 1)  # the piece that ends a valid path to each position
        best: list[float | None] = [0.0] + [None] * n  # score of the best path to each position
        from_: list[int | None] = [None] * (n + 1)  # its last piece
        apart, scores, single, done = self.apart, self.score, self.id, 0
        for at, (i, size) in self.automaton.iter(text):
            end = at + 1
            while done < at:  # a character that is no piece by itself can also be unknown
                done += 1
                other = best[done - 1] + self.low
                if best[done] is None or (best[done] < other and text[done - 1] not in single):
                    best[done], from_[done] = other, None
            score = best[end - size] + scores[i]
            if best[end] is None or score > best[end]:
                best[end], from_[end] = score, i
            if bpe and last[end] is None:
                before = last[end - size]
                if before is not None:
                    key = before << 24 | i
                    ok = apart.get(key)
                    if ok is None:
                        if len(apart) >= self.PAIRS:
                            apart.clear()
                        ok = apart[key] = self.stay_apart(before, i)
                    if not ok:
                        continue
                last[end] = i
        while done < n:
            done += 1
            other = best[done - 1] + self.low
            if best[done] is None or (best[done] < other and text[done - 1] not in single):
                best[done], from_[done] = other, None
        found = self.traced(from_, n)
        return self.traced(last, n) if bpe else found, found, best[n]

    def traced(self, last: list[int | None], end: int) -> list[int]:
        out = []
        while end:
            i = last[end]
            out.append(-end if i is None else i)
            end -= 1 if i is None else self.size[i]
        return out[::-1]

    def __missing__(self, text: str) -> tuple[bytes, bytes, float]:
        """Of a chunk: its ids as unsigned 32-bit, little-endian; those of its best path; and the score of that."""
        value = self.old.get(text)
        if value is None:
            own, best, score = self.paths(text)
            ids = self.numbers(own, text)
            value = ids, ids if best == own else self.numbers(best, text), score
        self[text] = value
        return value

    def learn(self, chunks: set[str]) -> None:
        """Makes chunks known, those that are not yet many at a time. No piece joins the characters on both sides of some ends, which are cut off first."""
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()
        parted, todo = {}, set()
        for text in chunks - self.keys():
            if text in self.old:
                self[text] = self.old[text]
                continue
            end = len(text)
            while end > 1 and text[end - 2 : end] not in self.inside:
                end -= 1
            if end == len(text):
                todo.add(text)
            else:
                parted[text] = [text[:end], *text[end:]]
                todo.update(t for t in parted[text] if t not in self)
        todo = sorted((t for t in todo if len(t) <= self.LONGEST), key=len)
        for i in range(0, len(todo), self.TOGETHER):
            self.relax(todo[i : i + self.TOGETHER])
        for text, parts in parted.items():
            found = [self[t] for t in parts]
            self[text] = b"".join(f[0] for f in found), b"".join(f[1] for f in found), sum(f[2] for f in found)

    def relax(self, chunks: list[str]) -> None:
        """``paths`` of many chunks, in order of length, at once: one step of the automaton for all of them, then their output links, longest piece first."""
        n, size = len(chunks), np.array([len(c) for c in chunks])
        longest, first = int(size[-1]), np.cumsum(size) - size
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        a, bpe = self.arrays, self.kind == BPE
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        taken, last = np.full((n, longest + 1), -1, np.int32), np.full((n, longest + 1), -1, np.int32)
        state = np.zeros(n, np.int64)
        for at in range(longest):
            here = np.arange(int(np.searchsorted(size, at, side="right")), n)  # chunks that have a character there
            kind = a.kind[code[first[here] + at]]
            state[here] = a.step(state[here], kind)
            end = at + 1
            row, at_node = here, a.output[state[here]]
            while True:
                some = at_node > 0
                if not some.any():
                    break
                row, at_node = row[some], at_node[some]
                i = a.piece[at_node]
                before = end - a.depth[at_node]
                score = best[row, before] + self.scores[i]
                better = score > best[row, end]
                best[row[better], end], taken[row[better], end] = score[better], i[better]
                if bpe:
                    left = last[row, before]
                    ask = np.flatnonzero(last[row, end] < 0)
                    ok = left[ask] < 0
                    pair = np.flatnonzero(~ok)
                    if len(pair):
                        ok[pair] = self.all_apart(left[ask[pair]].astype(np.int64) << 24 | i[ask[pair]])
                    last[row[ask[ok]], end] = i[ask[ok]]
                at_node = a.link[at_node]
            other = best[here, at] + self.low  # a character that is no piece by itself can also be unknown
            alone = a.single[kind]
            unknown = (best[here, end] < other) & (~alone | np.isneginf(best[here, end]))
            best[here[unknown], end], taken[here[unknown], end] = other[unknown], -1
        score = best[np.arange(n), size].tolist()
        found = self.all_traced(taken, size, chunks)
        own = self.all_traced(last, size, chunks) if bpe else found
        for c, x, y, z in zip(chunks, own, found, score, strict=True):
            self[c] = (x, x if x == y else y, z)

    def all_apart(self, pairs: np.ndarray) -> np.ndarray:
        """``stay_apart`` of pairs (left << 24 | right), remembered in a table with one place a hash."""
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        out = self.pair_ok[place]
        new = np.flatnonzero(self.pair_key[place] != pairs)
        if len(new):
            keys, index = np.unique(pairs[new], return_inverse=True)
            ok = np.array([self.stay_apart(k >> 24, k & 0xFFFFFF) for k in keys.tolist()], bool)[index]
            out[new] = self.pair_ok[place[new]] = ok
            self.pair_key[place[new]] = pairs[new]
        return out

    def all_traced(self, last: np.ndarray, size: np.ndarray, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk from the last piece of the path to every position (-1: an unknown character)."""
        rows, ends, ids, row, end = [], [], [], np.arange(len(size)), size.copy()
        while len(row):
            i = last[row, end]
            rows.append(row), ends.append(end), ids.append(i)
            end = end - np.where(i < 0, 1, self.sizes[i])
            row, end = row[end > 0], end[end > 0]
        row, end, i = (np.concatenate(x) for x in (rows, ends, ids))
        order = np.lexsort((end, row))
        row, end, i = row[order], end[order], i[order]
        odd = set(row[i < 0].tolist())
        data, bounds = i.astype("<u4").tobytes(), np.searchsorted(row, np.arange(len(size) + 1)) * 4
        out = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for r in odd:
            a, b = bounds[r] // 4, bounds[r + 1] // 4
            out[r] = self.numbers([x if x >= 0 else -e for x, e in zip(i[a:b].tolist(), end[a:b].tolist(), strict=True)], chunks[r])
        return out

    def numbers(self, path: list[int], text: str) -> bytes:
        ids = []
        for i in path:
            if i >= 0:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in text[-i - 1].encode("utf-8"))
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunks(self, text: str) -> list[str]:
        text = text.replace(" ", SPACE)
        return self.chunk.findall(SPACE + text if self.prefix else text) if text else []

    def merged(self, out: bytes) -> bytes:
        if self.bytes:
            return out
        ids = np.frombuffer(out, "<u4")  # neighbouring unknown characters are one id
        return ids[(ids != self.unknown) | (np.concatenate(([0], ids[:-1])) != self.unknown) | (np.arange(len(ids)) == 0)].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit, little-endian."""
        return self.encode_best(text)[0]

    def encode_best(self, text: str) -> tuple[bytes, bytes, float]:
        """The ids, those of the path with the highest sum of scores, and that sum."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes, float]]:
        chunked = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(chunked)))
        out = []
        for chunks in chunked:
            ids, best, score = zip(*map(self.__getitem__, chunks), strict=True) if chunks else ((), (), ())
            out.append((self.merged(b"".join(ids)), self.merged(b"".join(best)), math.fsum(score)))
        return out

    def decode(self, ids: bytes) -> str:
        # bytes beyond ASCII stand as lone surrogates until all pieces are joined
        text = "".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Pieces(f.read())
    return _loaded[path]


ENCODED = "doc_id long, n_ids long, ids binary, best_n_ids long, best_crc32 long, best_score double"


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids (unsigned 32-bit, little-endian) of every whole text; number, checksum and score of the best path's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        hold(model)
        for b in small(batches):
            ids, best, score = zip(*model.encode_all(b["text"].to_pylist()), strict=True)
            yield batch(
                doc_id=b["doc_id"], n_ids=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()), best_n_ids=pa.array([len(x) // 4 for x in best], pa.int64()),
                best_crc32=pa.array([zlib.crc32(x) for x in best], pa.int64()), best_score=pa.array(score, pa.float64()),
            )

    return documents(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``encode`` with, for ids, their checksum, and n_chars and text_sha256 of the text that they give back, and that text."""
    same = ["doc_id", "n_ids", "best_n_ids", "best_crc32", "best_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        hold(model)
        for b in small(batches, column="ids"):
            ids = b["ids"].to_pylist()
            text = [model.decode(x) for x in ids]
            yield batch(
                **{c: b[c] for c in same}, ids_crc32=pa.array([zlib.crc32(x) for x in ids], pa.int64()), n_chars=pa.array([len(t) for t in text], pa.int64()),
                text_sha256=pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]), text=pa.array(text, pa.string()),
            )

    return encoded.mapInArrow(run, "doc_id long, n_ids long, best_n_ids long, best_crc32 long, best_score double, ids_crc32 long, n_chars long, text_sha256 string, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents; the digest of the decoded text equals that of the source. Beside the ids, the path with the highest sum of scores."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return decode(encode(table(spark, sf_dir, "documents"), path), path).drop("text")
