import hashlib
import random

import numpy as np
import pytest

from tideline.llm import recompress, repeats

from .helpers import ODD, docs, empty


def brute(rows):
    """doc_id -> set of possible (n_words, n_removed, sha) by the definition."""
    texts = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in texts:
        if k is not None:
            for i in range(len(w) - 19):
                g = tuple(w[i : i + 20])
                first[g] = min(first.get(g, (k, i)), (k, i))
    out = {}
    for k, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - 19 if k is not None else 0):
            if first[tuple(w[i : i + 20])] < (k, i):
                gone[i : i + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(k, set()).add((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows):
    df = docs(spark, rows)
    got = repeats.find_repeats(df.repartition(3)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) in want[r.doc_id], r.doc_id


@pytest.mark.parametrize("seed,vocabulary", [(0, 3), (1, 30), (2, 2000)])
def test_equals_brute_force(spark, seed, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(8)]
    rows = []
    for k in range(120):
        t = []
        for _ in range(rng.randint(0, 4)):
            t += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.2:
                t += [rng.choice(words)] * rng.randint(5, 50)
            if rng.random() < 0.1:
                t += rng.sample(words, min(3, len(words))) * rng.randint(5, 20)
        rows.append((k * 7 % 120, rng.choice([" ", "\n", "  "]).join(t)))
    compare(spark, rows)


def test_odd_documents(spark):
    compare(spark, ODD)


def test_rows_that_share_an_id(spark):
    long = " ".join(f"v{i}" for i in range(30))
    compare(spark, [(1, long), (1, long), (1, "x " + long), (2, long + " y"), (None, long), (0, "a b")])


def test_pipeline_form(spark):
    long = " ".join(f"v{i}" for i in range(30))
    df = docs(spark, [(1, long), (2, f"a  b\n{long} c"), (3, "left\n alone"), (4, long), (5, None), (None, long)])
    out = repeats.without_repeats(df)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (long, len(long)), 2: ("a b c", 5), 3: ("left\n alone", 11), 4: ("", 0), 5: (None, 0), None: (long, len(long))}


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    long, other = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(0, long), (0, other), (1, long + " tail"), (1, "another text"), (2, long + " one"), (2, other + " two"), (2, other + " two"), (3, None), (3, "")]
    schema = "doc_id long, text string, left_text string, changed_doc_id long, row string, left string, text_key string, `a.b` int, n_words int, digest string"
    df = spark.createDataFrame([(i, t, f"l{k}", k, "r", "x", "y", k, 1, "d") for k, (i, t) in enumerate(rows)], schema)
    out = repeats.without_repeats(df)
    assert out.columns == df.columns
    got = {r.changed_doc_id: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    assert [got[k].text for k in range(len(rows))] == [long, other, "tail", "another text", "one", "two", "two", None, ""]
    assert all((r.left_text, r.row, r.left, r.text_key, r["a.b"], r.n_words, r.digest) == (f"l{k}", "r", "x", "y", k, 1, "d") for k, r in got.items())


def test_batches_are_cut_by_their_marks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MARK_BYTES", 1 << 22)
    test_marks_become_pieces(spark)
    compare(spark, [(k, " ".join(f"v{i % 40}" for i in range(k, k + 60))) for k in range(30)])


def test_empty_table(spark):
    assert repeats.find_repeats(empty(spark)).count() == 0
    assert repeats.without_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("vocabulary", [2, 5, 1000])
def test_anchors_depend_on_the_window_alone(vocabulary):
    rng = np.random.default_rng(vocabulary)
    names = rng.integers(0, 1 << 62, vocabulary).astype(np.uint64)
    window = names[rng.integers(0, vocabulary, 20)]
    seen = set()
    for _ in range(40):
        left, right = (names[rng.integers(0, vocabulary, rng.integers(0, 30))] for _ in range(2))
        x = np.concatenate((left, window, right))
        whole = np.arange(len(x)) + 20 <= len(x)
        name, at = recompress.anchors(recompress.levels(x, np.zeros(len(x), np.int64)), 20, whole)
        seen.add((int(name[len(left)]), int(at[len(left)] - len(left))))
    assert len(seen) == 1 and 0 <= next(iter(seen))[1] < 20


def test_rounds_shorten():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    found = recompress.levels(x, np.zeros(4000, np.int64), "RPPP")
    assert len(found[-1].name) < 2000
    for s in found:
        assert (s.start[1:] == s.end[:-1]).all() and s.start[0] == 0 and s.end[-1] == 4000
        assert (s.low <= s.start).all() and (s.high >= s.end).all()


def test_names_are_not_trusted(spark):
    text = " ".join(f"w{i}" for i in range(30))
    schema = "doc_id long, digest binary, text string, marks array<struct<at:array<int>,n:int,skip:int,words:binary>>"
    same, other = text.encode(), text.replace("w12 ", "x12 ").encode()
    rows = [(1, b"a", text, [([2, 5], 3, 2, same)]), (2, b"b", text, [([2], 3, 2, other)]), (3, b"c", text, [([2], 3, 1, same)]), (4, b"d", text, [([0], 1, 0, same), ([9], 2, 9, same)])]
    got = {r.doc_id: (r.n_removed, r.left) for r in repeats.cut(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (22, " ".join(f"w{i}" for i in (0, 1, *range(24, 30))))
    assert got[2] == got[3] == (0, text)
    assert got[4] == (30, "")


def test_marks_become_pieces(spark):
    schema = "doc_id long, digest binary, marks array<struct<at:int,n:int,lead_id:long,lead_digest:binary,lead_at:int>>"
    marks = [(70, 7, 1, b"x", 60), (77, 5, 1, b"x", 67), (80, 1, 1, b"x", 70), (5, 2, 1, b"x", 60), (8, 2, 1, b"x", 60), (300, 100, 9, b"y", 0)]
    got = {(tuple(r.at), r.n, r.lead_id, bytes(r.lead_digest), r.span, r.skip) for r in repeats.pieces(spark.createDataFrame([(3, b"z", marks)], schema)).collect()}
    assert got == {((70,), 4, 1, b"x", 0, 60), ((74,), 8, 1, b"x", 1, 0), ((5, 8), 2, 1, b"x", 0, 60), ((300,), 64, 9, b"y", 0, 0), ((364,), 36, 9, b"y", 1, 0)}
