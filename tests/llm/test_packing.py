import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import packing

from .helpers import docs, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
library = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, want, seq_len):
    """Every id in exactly one piece; offsets without gaps; only the last sequence short."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for k, found in by_doc.items():
        texts = want[k]
        assert sum(p.length for p in found) == sum(len(t) for t in texts)
        for p in found:
            assert any(zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and len(t) == p.doc_tokens for t in texts)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == seq_len or s == max(sequences) and at < seq_len
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("seq_len", [64, 2048])
def test_odd_documents(spark, seq_len):
    df = docs(spark)
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append(ids_of(r.text))
    pieces = packing.pack(df.repartition(3), PATH, seq_len=seq_len).collect()
    assert {p.doc_id for p in pieces} == set(want)
    check(pieces, want, seq_len)


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    df = docs(spark, [(1, "one two three four"), (2, "five six"), (3, None)])
    rows = packing.sequences(packing.pack(df, PATH, seq_len=16, with_ids=True), 16).collect()
    found = np.concatenate([np.frombuffer(r.ids, "<u4")[: r.n_tokens] for r in rows])
    assert sorted(found) == sorted(np.concatenate([ids_of(t) for t in ("one two three four", "five six", None)]))
    assert all(len(r.ids) == 64 or r.n_tokens & (r.n_tokens - 1) == 0 for r in rows)


def test_words_are_encoded_as_by_the_library():
    words = packing.word_ids(PATH)
    for t in ["a b\x1cc  d", "ΑΣ Σ ΟΔΟΣ", "é é x́", "<|endoftext|> x<|startoftext|>y", "İstanbul ǅ ŉ", "it's we'll 123 45. a,. b", "", "can't'S 'RE", "a\x85b c", "<|ENDOFTEXT|>", "Ab, AB. ab; x."]:
        assert words.ids(t) == ids_of(t)[:-1].tobytes()


@pytest.mark.parametrize("seed", range(12))
def test_schedule_places_every_token_once(seed):
    rng = np.random.default_rng(seed)
    totals = [int(x) for x in (rng.pareto(0.7, int(rng.integers(1, 12))) * 500).astype(int) % 100_000]
    length = int(rng.choice([16, 64, 2048]))
    plan = packing.schedule(totals, length, None if seed % 2 else [float(x) for x in rng.random(len(totals))])
    queue, at, n = [], [], []
    for q, total in enumerate(totals):
        x = 0
        while x < total:
            k = int(min(total - x, rng.integers(1, 900)))
            queue.append(q), at.append(x), n.append(k)
            x += k
    queue, at, n = (np.array(v, np.int64) for v in (queue, at, n))
    row, start, size, seq, offset = packing.place(plan, queue, at, n)
    order = np.lexsort((offset, seq))
    assert size.sum() == sum(totals)
    assert (seq[order] * length + offset[order] == np.concatenate(([0], np.cumsum(size[order])[:-1]))).all()
    assert (np.bincount(row, size, len(n)) == n).all()


def test_windows_follow_the_targets():
    totals = [60_000, 30_000, 10_000]
    plan = packing.schedule(totals, 1000)
    row, start, size, seq, _ = packing.place(plan, np.arange(3), np.zeros(3, np.int64), np.array(totals))
    for q, share in enumerate((600, 300, 100)):
        got = np.bincount(seq[row == q], size[row == q], seq.max() + 1)
        assert (abs(got[:-1] - share) <= 2).all()
        assert (abs(np.cumsum(got[:-1]) - share * np.arange(1, len(got))) <= 3).all()  # deficits do not add up


def test_windows_follow_shares_below_one_token():
    totals = [60_000_000, 39_970_000, 10_000, 10_000, 9_000, 900, 99, 1]
    plan = packing.schedule(totals, 2048)
    row, start, size, seq, _ = packing.place(plan, np.arange(8), np.zeros(8, np.int64), np.array(totals))
    for q, total in enumerate(totals):
        got = np.bincount(seq[row == q], size[row == q], seq.max() + 1)
        assert (abs(np.cumsum(got) - total / sum(totals) * 2048 * np.arange(1, len(got) + 1))[:-1] <= 3).all()
        assert got.sum() == total


def test_schedule_of_large_totals_is_exact():
    totals = [3 * 10**14 + 7, 10**14 + 1, 12_345]
    plan = packing.schedule(totals, 2048)
    for q, total in enumerate(totals):
        k = np.array([0, 1, total // 3, total // 2, total - 2, total - 1])
        queue = np.full(len(k), q)
        at = packing.position(plan, queue, k)
        before, after, _ = packing.turn(plan, queue, at // 2048)
        assert ((before <= k) & (k < after)).all()
        assert (abs(at - (k + 0.5) * (sum(totals) / total)) <= 3 * sum(totals) / total).all()


def test_targets_hold_until_a_queue_runs_out():
    totals, targets = [50_000, 50_000, 400], [0.75, 0.2496, 0.0004]
    plan = packing.schedule(totals, 1000, targets)
    row, start, size, seq, _ = packing.place(plan, np.arange(3), np.zeros(3, np.int64), np.array(totals))
    got = np.array([np.bincount(seq[row == q], size[row == q], seq.max() + 1) for q in range(3)])
    m = np.arange(1, 66)
    assert all((abs(np.cumsum(got[q])[:65] - targets[q] * 1000 * m) <= 3).all() for q in range(3))  # the first ends in window 66
    assert (got[0, 67:] == 0).all() and (got[1, 67:-1] > 980).all()


def by_source(pieces, seq_len):
    """source -> tokens by window, the padded last one left out."""
    last = max(p.sequence_id for p in pieces)
    found = {p.source: np.zeros(last, np.int64) for p in pieces}
    for p in pieces:
        if p.sequence_id < last:
            found[p.source][p.sequence_id] += p.length
    return found


def many_sources(spark, n, docs_each=4):
    rows = [(i, "one two three " * (3 + i % 4), f"source {i % n}") for i in range(n * docs_each)]
    want = {i: [ids_of(t)] for i, t, _ in rows}
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), want


@pytest.mark.parametrize("groups", [7, packing.GROUPS])
def test_every_source_has_its_share(spark, monkeypatch, groups):
    monkeypatch.setattr(packing, "GROUPS", groups)
    df, want = many_sources(spark, 700)
    pieces = packing.pack(df, PATH, seq_len=256).collect()
    check(pieces, want, 256)
    total = sum(p.length for p in pieces)
    for s, got in by_source(pieces, 256).items():
        share = sum(p.length for p in pieces if p.source == s) / total
        assert (abs(np.cumsum(got) - share * 256 * np.arange(1, len(got) + 1)) <= 3).all()


def test_mixture_names_any_number_of_sources(spark):
    df, want = many_sources(spark, 400)
    mixture = {f"source {i}": 1.0 + (i == 7) for i in range(300)} | {"": 100.0}
    pieces = packing.pack(df, PATH, seq_len=256, mixture=mixture).collect()
    check(pieces, want, 256)
    got = by_source(pieces, 256)
    m = np.arange(1, 60)  # no source has run out before
    assert (abs(np.cumsum(got["source 7"])[:59] - 2 / 401 * 256 * m) <= 3).all()
    assert all((abs(np.cumsum(got[f"source {i}"])[:59] - 1 / 401 * 256 * m) <= 3).all() for i in (0, 1, 299))
    assert (abs(np.cumsum(sum(got[f"source {i}"] for i in range(300, 400)))[:59] - 100 / 401 * 256 * m) <= 3).all()
