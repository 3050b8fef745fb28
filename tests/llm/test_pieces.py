import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tideline.llm import pieces

from .helpers import ODD, docs, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "\n", "\t", "a", "e", "t", "tion", "ing", "=", "-", "1", "é", "😀", "<", "s", ">", "the", "\r", "ß", "中文", "  \n", "́", "x", ".", "0", "'s"]


def texts(n, seed, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_equals_the_library():
    model, library = pieces.pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts(4000, 1) + [t or "" for _, t in ODD]:
        ids = library.encode(t)
        assert np.frombuffer(model.encode(t), "<u4").tolist() == ids, t
        assert model.decode(model.encode(t)) == library.decode(ids)


def unigram(byte_fallback):
    """A small unigram model, put together by hand."""
    rng = random.Random(7)
    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    if byte_fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    names = {"▁", "a", "b", "c", "d", "e"} | {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(120)}
    for p in sorted(names):
        m.pieces.add(piece=p, score=-rng.uniform(1, 9), type=1)
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_viterbi_is_the_best_path(byte_fallback):
    data = unigram(byte_fallback)
    model, library = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in texts(1500, 2, [" ", "  ", "a", "b", "c", "d", "e", "ab", "cde", "z", "é", "zz", "\n"]):
        assert np.frombuffer(model.encode(t), "<u4").tolist() == library.encode(t), t
    score = dict(zip(model.piece, model.score))

    def brute(t):
        if not t:
            return 0.0
        return max((score[t[:k]] + brute(t[k:]) for k in range(1, len(t) + 1) if t[:k] in model.id), default=-np.inf)

    for t in texts(60, 3, ["a", "b", "c", "d", "e"]):
        t = "▁" + t[:9]
        own, best, total = model.paths(t)
        assert own == best and sum(model.score[i] for i in best) == pytest.approx(total) == pytest.approx(brute(t))


def test_best_path_beside_the_ids():
    """The query's model: the path with the highest sum of scores, against all segmentations."""
    model = pieces.pieces(PATH)

    def brute(t):
        best = [0.0] + [-np.inf] * len(t)
        for end in range(1, len(t) + 1):
            best[end] = max([best[k] + model.score[model.id[t[k:end]]] for k in range(end) if t[k:end] in model.id and model.usable(t[k:end])], default=-np.inf)
            if t[end - 1] not in model.id:
                best[end] = max(best[end], best[end - 1] + model.low)
        return best[-1]

    for t in texts(300, 5) + ["internationalisation of tokenisers", "aaaaaaaaaaaaaaa", "中文" * 3000]:
        ids, best, score = model.encode_best(t)
        assert ids == model.encode(t)
        assert score == pytest.approx(brute((" " + t).replace(" ", "▁")) if t else 0.0)
        assert model.decode(best) == model.decode(ids)


def test_many_chunks_at_once_equal_one_by_one():
    model = pieces.pieces(PATH)
    chunks = {c for t in texts(3000, 8) + [t or "" for _, t in ODD] for c in model.chunks(t)}
    model.clear(), model.old.clear()
    model.learn(chunks)
    assert len(chunks - model.keys()) == sum(len(c) > model.LONGEST and c[-2:] in model.inside for c in chunks)
    for c in chunks:
        own, best, score = model.paths(c)
        assert model[c] == (model.numbers(own, c), model.numbers(best, c), score), c


def test_query(spark):
    import hashlib

    df = docs(spark)
    got = pieces.decode(pieces.encode(df.repartition(2), PATH), PATH).collect()
    model = pieces.pieces(PATH)
    by = {(r.doc_id, r.text or ""): r for r in df.collect()}
    for r in got:
        ids, best, score = model.encode_best(by[r.doc_id, r.text].text or "")
        assert (r.n_ids, r.best_n_ids, r.best_score) == (len(ids) // 4, len(best) // 4, score)
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())
    assert pieces.decode(pieces.encode(empty(spark), PATH), PATH).count() == 0
