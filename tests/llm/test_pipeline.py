import hashlib
import os

import numpy as np
import public_tokenizers
import pytest

from .helpers import ODD, docs, empty
from .test_forest import brute as alike
from .test_repeats import brute as repeated

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def through(spark, found, sf_dir, folder):
    """What each stage gets and gives, written and read again in between."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = found
        stage(spark, before, sf_dir).write.parquet(str(folder / name))
        found = spark.read.parquet(str(folder / name))
        out[name] = before, found
    return out


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_stages_equal_brute_force(spark, tmp_path):
    """Stages that have one right answer, against the definition, each on what the one before kept; and nothing else changes."""
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = through(spark, source, SMALL, tmp_path)
    rows = {n: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()} if n != "packing" else b.collect()) for n, (a, b) in out.items()}
    assert all(b.columns == source.columns for n, (_, b) in out.items() if n != "packing")
    for name in ("toxicity", "quality", "near_duplicates"):
        before, after = rows[name]
        assert all(before[k] == r for k, r in after.items())
    before, after = rows["near_duplicates"]
    classes = alike([(k, r.text) for k, r in before.items()])
    assert set(after) == {k for k, (c, _, _) in classes.items() if k == c}
    before, after = rows["substring_dedup"]
    want = repeated([(k, r.text) for k, r in before.items()])
    assert set(after) == set(before)
    for k, r in after.items():
        (n, gone, sha), = want[k]
        assert hashlib.sha256(" ".join((r.text or "").encode().decode().split(" ")).encode()).hexdigest() == sha if gone else r == before[k]
    before, pieces = rows["packing"]
    library, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {k: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for k, r in before.items()}


@pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="no test tables here")
def test_filters_keep_the_clean(spark, tmp_path):
    """Where there is something to learn from: toxic documents go, clean ones stay, bad ones mostly go."""
    found = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, found, MIDDLE).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in found.select("doc_id").collect()}
    toxic, clean = ({k for k, r in labels.items() if r.toxic == t} for t in (1, 0))
    assert len(toxic & left["toxicity"]) <= 0.1 * len(toxic) and len(clean - left["toxicity"]) <= 0.02 * len(clean)
    good, bad = ({k for k, r in labels.items() if r.quality == q and k in left["toxicity"]} for q in (1, 0))
    assert len(good - left["quality"]) <= 0.03 * len(good) and len(bad & left["quality"]) <= 0.15 * len(bad)


def test_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = docs(spark, [*ODD, *ODD])
    out = through(spark, odd, str(tmp_path), tmp_path / "odd")
    assert all(b.columns == odd.columns for n, (_, b) in out.items() if n != "packing")
    kept = out["near_duplicates"][1].collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "5", "8", "9", "10", "None", "None"])
    assert {str(p.doc_id) for p in out["packing"][1].collect()} == {str(r.doc_id) for r in kept}
    out = through(spark, empty(spark), str(tmp_path), tmp_path / "empty")
    assert all(b.count() == 0 for _, b in out.values())


def test_shared_ids_and_clashing_columns_lose_no_text(spark, tmp_path):
    """Every text that no stage has a reason to touch is packed once, whatever shares its id and whatever the columns are called."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long, other = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    apart = lambda k: " ".join(f"{chr(97 + k)}{i}" for i in range(25))
    rows = [(0, f"{long} {apart(0)}"), (0, f"{other} {apart(1)}"), (1, f"{long} {apart(2)}"), (1, apart(3)), (2, f"{apart(4)} {long}"), (2, f"{apart(5)} {other}"), (2, f"{apart(5)} {other}"), (None, apart(6))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, left_text string, changed_doc_id string, row_doc_id string, row string, text_key string, score string"
    df = spark.createDataFrame([(i, t, "en", "s", len(t), *"abcdef") for i, t in rows], schema)
    out = through(spark, df, str(tmp_path), tmp_path / "out")
    after = out["substring_dedup"][1].collect()
    assert sorted(r.text for r in after) == sorted([rows[0][1], rows[1][1], apart(2), apart(3), apart(4), apart(5), apart(6)])
    assert all(tuple(r)[5:] == tuple("abcdef") for r in after)
    pieces = out["packing"][1].collect()
    assert sorted(str(p.doc_id) for p in pieces) == sorted(["0", "0", "1", "1", "2", "2", "None"])
