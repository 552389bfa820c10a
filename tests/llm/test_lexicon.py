"""Ids and texts against the tokenizers library, and the lexicon against a dictionary."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm.lexicon import Lexicon, Merger, bpe_decode, bpe_digests, bpe_encode, compile_lexicon
from pixelframe.llm.tokens import default_path

VOCABULARY = default_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    plain = ["hello", "World", "it's", "WE'LL", "don't", "e.g.", "12345", "a_b", "naïve", "Straße", "ΣΊΣΥΦΟΣ", "日本語", "éa", "İ", "x y", "q\x1cr", "\x85", " z", "🙂👍🏽", "‍", "ﬁ", "İ", "\x00", "\x7f", "'s", "''ll"]
    special = ["<|endoftext|>", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"]
    out = [None, "", " \t\n", "<|endoftext|>", "a" * 5000, "ab" * 3000, "x y " * 4000, "!?" * 900, "é" * 700]
    for _ in range(300):
        out.append("".join(rng.choice(plain + special) + rng.choice([" ", "\n", "\t", "  ", "\r\n", ",", ""]) for _ in range(rng.randrange(40))))
    for _ in range(200):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x10000, 0x1F700)])) for _ in range(rng.randrange(60))).replace("\ud800", ""))
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("most_words", [1 << 17, 7, 0])
def test_ids_and_texts_are_the_library_s(spark, texts, library, most_words):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string").repartition(3)
    for c in ("word", "n", "ids", "_text", "_id", "n_tokens"):
        docs = docs.withColumn(c, F.lit("x"))
    want = []
    for i, t in [*rows, *rows[:3]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = bpe_digests(docs, most_words=most_words)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_encode_then_decode(spark, texts, library):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe_encode(docs)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(ids[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe_decode(encoded).collect()}
    assert all(back[i] == library.decode(x, skip_special_tokens=False) for i, x in ids.items())


def test_empty_table(spark):
    assert bpe_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lexicon_is_a_dictionary(tmp_path):
    rng = random.Random(4)
    words = {bytes(rng.choices(b"abcde", k=rng.randrange(1, 9))): tuple(rng.choices(range(6), k=rng.randrange(4))) for _ in range(3000)}
    known = sorted(words)[::2]
    (tmp_path / "l.bin").write_bytes(compile_lexicon(known, [words[w] for w in known]))
    lexicon = Lexicon(str(tmp_path / "l.bin"))
    asked = sorted(words) + [b"", b"zz", b"abcdeabcdeabcde"]
    ends = np.cumsum([len(w) for w in asked])
    found, ids, sizes = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), ends - [len(w) for w in asked], np.array([len(w) for w in asked]))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for k, w in enumerate(asked):
        assert found[k] == (w in set(known))
        assert tuple(ids[upto[k] : upto[k + 1]]) == (words[w] if found[k] else ())


def test_lexicon_is_minimal(tmp_path):
    """Equal endings are one state: as many states as there are different sets of (ending, ids) after some beginning."""
    words = sorted({s + e for s in (b"walk", b"talk", b"b", b"bo") for e in (b"", b"s", b"ing", b"ed")})
    ids = [(k,) for k in range(len(words))]
    data = np.frombuffer(compile_lexicon(words, ids), "<i4")
    assert data[4] < len({w[:k] for w in words for k in range(len(w) + 1)}) * 0.7
    same = np.frombuffer(compile_lexicon(words, [()] * len(words)), "<i4")
    rights = {frozenset(w[k:] for w in words if w[:k] == p) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert same[4] == len(rights)


def test_merges_one_by_one_agree(texts):
    merger = Merger(VOCABULARY)
    assert merger.at_once
    words = sorted({w for t in texts if t and len(t) < 3000 for w in t.split()})
    at_once = merger.encode(words)
    merger.at_once = False
    one_by_one = merger.encode(words)
    assert (at_once[0] == one_by_one[0]).all() and (at_once[1] == one_by_one[1]).all()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Merger(default_path("byte_bpe_50k.json"))
