"""The stages over the small driver tables, each against a brute-force version on its own input."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from eatlas.llm import mixing, quality  # noqa: E402

from .test_line_dedup import brute as brute_lines  # noqa: E402
from .test_shingle_dedup import brute as brute_near  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, as written and read again; the input stands at -1."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {-1: docs}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        found[k] = docs = spark.read.parquet(path)
    return found


def test_all_but_the_last_return_documents(stages):
    names = stages[-1].columns
    assert len(corpus_pipeline.STAGES) == 5
    assert all(stages[k].columns == names for k in range(4))
    assert all(r["n_chars"] == len(r["text"]) for k in range(4) for r in stages[k].collect())


def test_classifier_rejects_only_poor_texts(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[0].collect()}
    every = {r["doc_id"] for r in stages[-1].collect()}
    assert kept < every
    known = [(d in kept) == bool(labels[d]) for d in every if d in labels]
    assert sum(known) / len(known) > 0.95
    model = quality.train(stages[-1], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert kept == {r["doc_id"] for r in quality.scored(stages[-1], model).collect() if r["score"] >= 0.3}


def test_lines_go_as_by_brute_force(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    want = {d: kept.decode() for d, _, _, kept in brute_lines(rows)}
    assert {r["doc_id"]: r["text"] for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    kept = sorted(r["doc_id"] for r in stages[2].collect())
    want, links = brute_near([(r["doc_id"], r["text"]) for r in stages[1].collect()])
    assert kept == want and links
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == {d: texts[d] for d in kept}


def test_mix_holds_what_its_digest_takes(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(stages[2]).collect() if r["taken"]}
    words = collections.Counter()
    for r in stages[3].collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
    assert dict(words) == taken


def test_pieces_give_every_text_back(spark, stages):
    rows = stages[4].collect()
    assert len(rows) == stages[3].count() and all(r["lossless"] for r in rows)
    assert rows and sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r["doc_id"] for r in rows)
