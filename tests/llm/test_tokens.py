"""The encoder gives what the library gives."""

import random
from array import array

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from setweave.llm import tokens as T

VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = [" ", "\n", "  ", "\t", "a", "B", "é", "'s", "'S", ".", ",", "!", "1", "23", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " ", "\x1c", "ẖ", "H̱", "́", " ́", "Σ", "\r\n", "日本", "²", " ", " ", "don't", "ǅ", "the", "and,", "thorre."]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", "x" * 3000, "word " * 3000, "\n", " "] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(n)]


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("pieces", [300_000, 5])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_same_ids_as_the_library(name, pieces, special_as_text, monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", pieces)
    enc, library = T.Encoder(T.vocabulary(name), special_as_text), Tokenizer.from_file(T.vocabulary(name))
    library.encode_special_tokens = special_as_text
    rows = texts(1500)
    for _ in range(2):  # the second time from the cache
        for k in range(0, len(rows), 500):
            for t, ids in zip(rows[k : k + 500], enc.many(rows[k : k + 500]), strict=True):
                assert array("I", ids).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_special_strings():
    plain = lambda name, t: Tokenizer.from_file(T.vocabulary(name)).encode(t, add_special_tokens=False).ids
    for name, end in zip(VOCABULARIES, (49407, 50256), strict=True):
        for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n<|endoftext|> z", "<|ENDOFTEXT|> a  <|endoftext|>"):
            got = array("I", next(T.encoder(T.vocabulary(name)).many([t]))).tolist()
            assert got == plain(name, t) and end in got
            assert end not in array("I", next(T.encoder(T.vocabulary(name), True).many([t])))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_end_ids_and_nulls(name):
    enc = T.encoder(T.vocabulary(name))
    ids, ends = enc.flat(pa.array([None, "a b", ""]), 7)
    ab = enc.tok.encode("a b", add_special_tokens=False).ids
    assert ids.tolist() == [7, *ab, 7, 7] and ends.tolist() == [1, len(ab) + 2, len(ab) + 3]
    assert [len(x) for x in enc.flat(pa.array([], pa.string()), 7)] == [0, 0]


def test_another_vocabulary_is_encoded_text_by_text(tmp_path):
    import json

    spec = json.load(open(T.vocabulary("word_bpe_49k.json")))
    spec["normalizer"] = {"type": "Lowercase"}
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    enc = T.Encoder(str(tmp_path / "v.json"))
    assert enc.kind == "other"
    for t, ids in zip(texts(50), enc.many(texts(50)), strict=True):
        assert array("I", ids).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", VOCABULARIES)
def test_words_that_are_not_kept(name):
    enc = T.Encoder(T.vocabulary(name))
    words = sorted({w for t in texts(600, 3) for w in t.split() if not any(c.isspace() for c in w)} - {""})
    seen = set()
    for at, ids, n in enc.once(words):
        for i, part in zip(at, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            seen.add(int(i))
            assert part.tolist() == enc.tok.encode(enc.rest.prefix + words[i], add_special_tokens=False).ids, words[i]
    assert len(seen) == len(words)
