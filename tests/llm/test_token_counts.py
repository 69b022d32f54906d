import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eatlas.llm import token_counts

from .helpers import collected, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b ", "  ", "\n", " ", "é", "日本", "<|endoftext|>", "'s", "​", "\xa0", "\x1c", "1 ", "!!", "\t", "😀", "́", "foo bar", "<|end", "oftext|>", "　", "﻿"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_equal_to_the_library(library):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 100)))
        counter = token_counts.Counter(PATH, rng.choice([4, 8, 30]), rng.choice([2, 4, 8]))
        assert counter.long(text) == counter.short([text])[0] == library(text), text


def test_long_texts_without_a_boundary(library):
    counter = token_counts.Counter(PATH, 50, 4)
    for text in ("x" * 1000, " " * 1000, "a\n" * 500, "word " * 300):
        assert counter.long(text) == library(text)


def test_counts_of_a_table(spark, library):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    rows += [(40, None), (41, ""), (None, "no id"), rows[0], (42, "many words " * 2000)]
    got = collected(token_counts.token_counts(documents(spark, rows), PATH, chunk=500), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(((d, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for d, t in rows), key=str)
    assert token_counts.token_counts(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("unit", ["A short line, and it's here\n", "今日は良い天気です。明日は、たぶん「雨」でしょう！", "word ", "tab\tand\r\nline 7\n"])
def test_long_texts_go_in_chunks(unit):
    """Lines, a script without blanks, and words: no call encodes much more than a chunk."""
    counter = token_counts.Counter(PATH, chunk=2000, overlap=64)
    text, seen = unit * (40_000 // len(unit)), []
    encode = counter._boundaries
    counter._boundaries = lambda t, a, b: seen.append(b - a) or encode(t, a, b)
    assert counter.long(text) == len(token_counts._tokenizer(PATH).encode(text, add_special_tokens=False))
    assert max(seen) <= 2000 + 64 + len(unit)
