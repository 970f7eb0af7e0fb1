"""Random texts and very long words against the library."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece

from veriloom.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def count():
    return token_counts._counter(PATH)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_fuzz(count, lib):
    rng = random.Random(9)
    bits = ["²", "½", "①", ".", ",", " ", "\n", "\t", "▁", "é", "ß", "ª", "日", "本", "_", "-", "1", "2", "(", ")", "#", "ab", "the", "tion", "X", "😀", "ु", "र", "'s", '"', "x²", "Ⅳ", "٣"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(20_000)]
    assert count(texts).tolist() == [len(x) for x in lib.encode(texts)]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", "=-", "0123456789", "ABCDEFabcdef0123456789+/"])
def test_long_words(count, lib, letters):
    rng = random.Random(len(letters))
    for n in (token_counts.LONG - 1, token_counts.LONG + 1, 5_000):
        text = "".join(rng.choices(letters, k=n))
        assert count([text]).tolist() == [len(lib.encode(text))]


def test_time_of_a_very_long_word(count, lib):
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
    began = time.perf_counter()
    got = count([text]).tolist()
    assert time.perf_counter() - began < 5 and got == [len(lib.encode(text))]
