import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from tideline.llm import resampling
from tideline.llm.common import Scratch

from .helpers import ODD, docs, empty

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, least=20):
    """What the contract says, one feature after another."""
    held, wanted = [0] * 10_000, [0] * 10_000
    for into, texts in ((held, [t for _, t in rows]), (wanted, target)):
        for f in (f for t in texts for f in features(t)):
            into[zlib.crc32(f.encode()) % 10_000] += 1
    s, t = sum(held), sum(wanted)
    gain = [math.floor(1000 * math.log(float(b + 1) * (s + 10_000) / (float(a + 1) * (t + 10_000)))) for a, b in zip(held, wanted, strict=True)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in out)))


def got(df):
    return sorted(str(list(r)) for r in df.collect())


def test_equals_brute_force_on_odd_texts_ties_and_repeats(spark):
    many = [(100 + k % 90, f"Some Words {k % 7} of a text 9é{k % 5} " * 4 + "the target's own words" * (k % 3)) for k in range(200)]
    rows = [*ODD, *ODD, *many]
    target = ["the target's own words", None, "", "THE TARGET of words"]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 37, 100):
        assert got(resampling.resample(docs(spark, rows), wanted, percent=percent)) == brute(rows, target, percent)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), nothing).count() == 0
    assert got(resampling.resample(docs(spark), nothing)) == brute(ODD, [])


def test_a_text_in_pieces_has_the_same_runs():
    text = " ".join(f"w{k % 17}é" if k % 5 else "x" * (k % 40) for k in range(3000))
    texts = pa.array(["first one", text, "", "last one here"]).slice(0, 4)
    want = sorted(f for t in texts.to_pylist() for f in features(t))
    for limit in (40, 1000, 1 << 20):
        count = {}
        for s in resampling.segments(texts, limit):
            for level in resampling.trie(s):
                for state, n in zip(level.state.tolist(), level.count.tolist(), strict=True):
                    count[state] = count.get(state, 0) + n
        there = {}
        for f in want:
            there[zlib.crc32(f.encode())] = there.get(zlib.crc32(f.encode()), 0) + 1
        assert {k: n for k, n in count.items() if n} == there


def test_states_go_on_as_crcs_do():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        before, more = int(rng.integers(0, 1 << 32)), rng.bytes(n)
        moved = resampling.mapped(resampling.behind(n), np.array([before], np.uint32))[0]
        assert int(moved) ^ zlib.crc32(more) == zlib.crc32(more, before)


def test_ranks_over_many_ranges(spark):
    rows = [(k * 7919 % 1000 if k % 10 else None, k % 13, k) for k in range(1000)]
    found = spark.createDataFrame(rows, "doc_id long, score long, row long").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    out = {r.row: r.rank for r in resampling.ranked(found, Scratch(spark), 50).collect()}
    assert [out[r[2]] for r in want[:500]] == list(range(1, 501)) and all(out[r[2]] is None for r in want[500:])
