"""The registered queries themselves on the smallest tables, against brute force, the libraries, and their SQL."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tideline.llm import pieces, queries

from .test_forest import brute as alike
from .test_repeats import brute as repeated

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else str(v)
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in result.fetchall())


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, places = {}, {}
    for r in run(spark, "op1_packing"):
        got.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert found[0][0] == 0 and sum(n for _, n in found) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(found, found[1:]))
    assert set(got) == {k for k, _ in texts}
    for k, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(got[k], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1]) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_op2(spark, texts):
    want = alike(texts)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in run(spark, "op2_ngram_join")} == want


def test_op4(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op4_media")}
    for k, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.rgb) == 3 * r.height * r.width and r.feature.startswith(f"{r.width}x{r.height}:") and r.feature.endswith(f"{zlib.crc32(r.rgb):08x}")


def test_op6(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.pieces(path)
    got = {r.doc_id: r for r in run(spark, "op6_sentencepiece")}
    for k, t in texts:
        ids = library.encode(t or "")
        r = got[k]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.n_chars == len(t or "")
        unknown = sum(c not in model.id for c in (t or "").replace(" ", pieces.SPACE))
        assert r.best_score >= sum(library.get_score(i) for i in ids if not library.is_byte(i)) + unknown * model.low  # no path is better, the library's neither


def test_op7(spark, texts):
    want = repeated(texts)
    for r in run(spark, "op7_substring_dedup"):
        assert (r.n_words, r.n_removed, r.kept_sha256) in want[r.doc_id]


def test_op10(spark):
    t = spark.read.parquet(f"{DATA}/embeddings.parquet").toArrow()
    ids, x = t["vec_id"].to_numpy(), t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(t), -1).astype(float)
    unit, hits, asked = x / np.linalg.norm(x, axis=1)[:, None], 0, ids[ids % 50 == 0]
    got = {}
    for r in run(spark, "op10_neighbours"):
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(asked)
    for q, found in got.items():
        i = int(np.flatnonzero(ids == q)[0])
        score = unit @ unit[i]
        best = [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:5]
        hits += len(set(best) & {v for v, _ in found.values()})
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found.values())
    assert hits >= 0.9 * 5 * len(asked)


def test_op12(spark, texts):
    from .test_codes import brute

    assert sorted(map(tuple, run(spark, "op12_token_codes"))) == brute(texts)


def test_op11_and_op13_by_definition(spark):
    from .test_divergence import brute as apart
    from .test_resampling import brute as weighed

    found = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(str(list(r)) for r in run(spark, "op11_resampling")) == weighed([(r.doc_id, r.text) for r in found], target)
    assert sorted(map(tuple, run(spark, "op13_divergence"))) == apart([(r.text, r.lang, r.source) for r in found])
