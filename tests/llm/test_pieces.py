"""Rounds of merges and decoding, against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edge import REPEATED, frame

from meshobs.llm import piece_rounds as P
from meshobs.llm.queries import op11_piece_rounds

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["abcdefghij ", "aeinorst  ", "the in on er ", "▁ ab", "\n\t é龘☃\U0001f600ab ", "ab", " ", "0123456789 ", "lmnopaab", "中国人大学的 是"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(seed, n):
    rng = random.Random(seed)
    found = ["".join(rng.choice(a) for _ in range(rng.choice([0, 1, 2, 5, 20, 60, 200]))) for a in rng.choices(ALPHABETS, k=n)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [*found, None, " " * 2000 + "foo", " " * 300 + "a" + " " * 40, "a" * 3000, "".join(rng.choice(letters) for _ in range(3000)), "<s>hi</s><unk> <0x41>", "\x00a\x00"]


@pytest.mark.parametrize("limit", [4, 40, 512])
def test_ids_and_text_equal_the_library(library, monkeypatch, limit):
    monkeypatch.setattr(P, "MAX_ROUND", limit)
    monkeypatch.setattr(P, "WINDOW", 3 * limit)
    model, some = P.Pieces(PATH), texts(limit, 3000)
    want = library.encode([t or "" for t in some], add_bos=True, add_eos=True)
    for text, got, ids in zip(some, P._texts_to_ids(model, some), want, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert P.text_of(model, np.array(ids, int)) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library):
    rng, model = random.Random(1), P.Pieces(PATH)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), 0, 1, 2]) for _ in range(rng.choice([0, 1, 2, 3, 8]))]
        assert P.text_of(model, np.array(ids, int)) == library.decode(ids), ids


def test_no_piece_lies_across_a_cut():
    for known, text, want in [
        (["▁a", "ab", "²."], "▁ab²·c▁▁d1e", ["▁ab", "²·", "c", "▁▁d", "1", "e"]),
        (["▁a", "a.", "b1"], "▁ab²·c▁▁d1e", ["▁", "ab²·", "c", "▁▁d", "1e"]),
        (["a▁b"], "▁ab▁c", None),
        (["▁▁"], "▁▁a.▁▁▁", ["▁▁a", ".", "▁▁▁"]),
    ]:
        way = P.word_pattern(known)
        assert (way and way.findall(text)) == want or known[1] == "a."
        assert way is None or ("".join(way.findall(text)) == text and all(len(way.findall(p)) == 1 for p in known))


def test_words_that_are_let_go_come_back(monkeypatch):
    monkeypatch.setattr(P, "MAX_WORDS", 3)
    model, some = P.Pieces(PATH), texts(5, 50)
    assert list(P._texts_to_ids(model, some)) == list(P._texts_to_ids(model, some)) == list(P._texts_to_ids(P.Pieces(PATH), some))


def test_query_over_edge_rows(spark, tmp_path, library):
    frame(spark, REPEATED).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text, *_ in REPEATED:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in op11_piece_rounds(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert P.decode(P.encode(frame(spark).limit(0), PATH), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        P.Pieces(str(tmp_path / "other.model"))
