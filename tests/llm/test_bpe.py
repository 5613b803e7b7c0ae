"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from merchlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, word_memory=50)


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_character_is_split_as_the_library_splits(library, own):
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for start in range(0, len(points), 256):
        # Runs of like characters hide nothing: each stands among letters, digits, marks and spaces.
        text = "".join(f"a{chr(p)}a 1{chr(p)}1 !{chr(p)}! {chr(p)} x" for p in points[start : start + 256])
        if bpe.SETTLED.fullmatch(text):
            assert own._split(text) == [text[a:b] for _, (a, b) in own.splitter.pre_tokenize_str(text)], hex(points[start])
        elif start % 8192 == 0:
            assert ids_of(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_library(library, own):
    rng = random.Random(5)
    pieces = ["the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中文", "🙂", "á", "<|endoftext|>", "<|endof", "12345", "\x00", "　", "--", "aaaa", "�"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choices("abcdeéz", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert ids_of(got) == want
        assert own.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_long_words(library, own):
    rng = random.Random(2)
    for word in ("a" * 30_000, "".join(rng.choices("etaoinshr", k=20_000)), "é" * 5_000):
        assert ids_of(own.encode(word)) == library.encode(word, add_special_tokens=False).ids


def test_the_root_is_the_leftmost_lowest_rank():
    # Symbols 0..3; pairs (0,0) and (1,0) with ranks 1 and 0.
    merger = bpe.Merger({(1, 0): 0, (0, 0): 1, (5, 5): 2}, [4, 5, 6])
    assert merger.merge([0, 0, 0, 0, 0]) == [6, 0]
    assert merger.merge([0, 0, 1, 0, 0]) == [5, 4, 0]
    assert merger.merge([2]) == [2] and merger.merge([]) == []


def test_broken_sequences_decode_as_the_library_does(library, own):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_table_of_texts(spark, library):
    texts = [None, "", " ", "Hello world", "Hello world", "word " * 50_000, "tail\n\n ", "<|endoftext|>"]
    rows = [(None if i == 3 else i // 2, t, "en", 1, b"x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, tokens int, decoded binary")
    got = bpe.tokens_digest(bpe.round_trip(df, PATH)).collect()

    def expected(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        return key, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    back = bpe.decode_tokens(bpe.encode_texts(df, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for t in texts)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
