import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tideline.llm import codes
from tideline.llm.common import Scratch
from tokenizers import Tokenizer

from .helpers import ODD, docs, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """(doc_id, start, n_tokens, crc) by the library, in order of doc_id."""
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("top", [1, 2, 255, 256, 50_257, (1 << 32) - 1])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 70_000])
def test_ids_at_any_position(top, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, top, n, endpoint=True), (rng.pareto(0.5, n) * 20).astype(np.int64)).astype(np.uint32)
    ids[n // 2] = top
    ends = np.unique(np.append(rng.integers(0, n, 5), n))
    content = codes.encode(ids, [None, *range(len(ends) - 1)], ends, 3, 4)
    for found in (codes.Codes(content), codes.Codes(content + b"\n")):
        assert (found.part, found.nth, found.n_docs, found.n_ids) == (3, 4, len(ends), n)
        some = rng.integers(0, n, 1000)
        assert (found.at(some) == ids[some]).all() and (found.at(np.arange(n)) == ids).all() and not len(found.at(np.zeros(0, np.int64)))
        for a, b in np.sort(rng.integers(0, n, (20, 2), endpoint=True)).tolist():
            assert (found.between(a, b) == ids[a:b]).all()
        assert [found.document(k).tolist() for k in range(len(ends))] == [x.tolist() for x in np.split(ids, ends[:-1])]
        assert not found.known[0] and found.known[1:].all() and found.doc_ids[1:].tolist() == list(range(len(ends) - 1))


def test_codes_are_small_and_damage_is_found():
    ids = np.random.default_rng(1).zipf(1.3, 200_000).clip(0, 50_000).astype(np.uint32)
    content = codes.encode(ids, [1], np.array([len(ids)]))
    assert len(content) < 0.7 * 2 * len(ids)
    assert sum(codes.widths(ids)) == 16 and len(codes.widths(ids)) > 1
    for at in (0, 9, 30, len(content) // 2, len(content) - 1):
        with pytest.raises(ValueError, match="damaged"):
            codes.Codes(content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n", "\n\n", "\t", "\xa0", "\x85", "\x1c", "　", "word", "Don't", "É,", "x.", "...", "42", "a1", "'s", "中文", "😀", "ß", "​", "<|endoftext|>", "K", "ſ,"]), max_size=12).map("".join))
def test_pieces_have_the_library_s_ids(text):
    words = codes.piece_ids(PATH)
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark):
    rows = [*ODD, *((k * 37 % 500 - 100, f"text {k} of many, " * (k % 9)) for k in range(500))]
    folder = Scratch(spark).root
    listed = codes.write(docs(spark, rows).repartition(3), folder, PATH, file_tokens=700)
    want = brute(rows)
    got = sorted(map(tuple, codes.read_documents(spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0
    files = listed.orderBy("start").collect()
    assert len(files) > 10 and sum(f.n_docs for f in files) == len(rows) and all(a.start + a.n_ids == b.start for a, b in zip(files, files[1:], strict=False))
    unlike = [r for r in rows if r[0] is not None]
    assert len({r.file for r in files}) == len(files) and len(unlike) < len(rows)


def test_ids_at_positions_of_the_corpus(spark):
    rows = [(k, f"text {k}, of many " * (k % 7)) for k in range(300)]
    folder = Scratch(spark).root
    codes.write(docs(spark, rows), folder, PATH, file_tokens=500)
    library = Tokenizer.from_file(PATH)
    ids = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 2]]
    asked = [0, 1, 499, 500, 501, len(ids) - 1, len(ids), 10**12, -1, 7, 7, *range(100, len(ids), 97)]
    found = codes.tokens_at(spark.createDataFrame([(p,) for p in asked], "position long"), folder, step=400).collect()
    assert sorted(map(tuple, found)) == sorted((p, ids[p]) for p in asked if 0 <= p < len(ids))


def test_an_empty_table(spark):
    folder = Scratch(spark).root
    assert codes.write(empty(spark), folder, PATH).count() == 0
    assert codes.read_documents(spark, folder).count() == 0
    assert codes.tokens_at(spark.createDataFrame([(0,)], "position long"), folder).count() == 0
