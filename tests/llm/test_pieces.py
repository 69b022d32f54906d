import collections
import random

import numpy as np
import public_tokenizers
import sentencepiece

from eatlas.llm import pieces

from .helpers import collected, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the ", " ", "  ", "\n", "é", "日本", "▁", "😀", "\t", "\x00", "ß", "￿", "q̈", "    ", "\n\n", "There"]


def keys(*values):
    return np.array(values, np.uint64)


def test_sampling_follows_the_lattice():
    vocab = pieces.vocabulary(PATH)
    spelt = {vocab.spelling[i].decode(): i for i in range(259, 32000)}

    def ways(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if text[:n] in spelt:
                yield from ((spelt[text[:n]], *rest) for rest in ways(text[n:]))

    weights = {w: float(np.exp(sum(vocab.weight[i] for i in w))) for w in ways(" there")}
    n = 40_000
    drawn = pieces.encode(vocab, [" there"] * n, np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64), np.zeros(n, np.int64))
    counts = collections.Counter(tuple(d.tolist()) for d in drawn)
    total = sum(weights.values())
    assert set(counts) <= set(weights)
    assert max(abs(counts[w] / n - weights[w] / total) for w in weights) < 0.01


def test_segments_and_batches_do_not_change_pieces():
    vocab = pieces.vocabulary(PATH)
    rng = random.Random(3)
    for key in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))
        parts = list(pieces.segments(vocab, text, rng.choice([3, 7, 20])))
        assert "".join(parts) == " " + text
        ahead = np.cumsum([0] + [len(vocab.units.findall(p)) for p in parts])[:-1]
        cut = np.concatenate(pieces.encode(vocab, parts, np.full(len(parts), key, np.uint64), ahead))
        whole = pieces.encode(vocab, ["x", " " + text], keys(9, key), np.zeros(2, np.int64))[1]
        assert cut.tolist() == whole.tolist()
        assert pieces.decode(vocab, whole.tolist()) == text.encode()


def test_table_round_trips(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "no id"), rows[0], (52, "word " * 500)]
    found = pieces.encoded(documents(spark, rows), PATH, batch=100)
    got = collected(found, "doc_id", "n_pieces", "lossless", "ids")
    assert got == collected(pieces.encoded(documents(spark, rows).repartition(3), PATH), "doc_id", "n_pieces", "lossless", "ids")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = sorted(rows, key=lambda r: str(r[0]))
    assert len(got) == len(texts) and all(r[2] and r[1] == len(r[3]) for r in got)
    by_id = {r[0]: r[3] for r in got}
    for doc_id, text in texts:
        if text and "▁" not in text:
            assert library.decode(by_id[doc_id]) == text
    assert by_id[50] == by_id[51] == []
    assert pieces.encoded(documents(spark, []), PATH).count() == 0
