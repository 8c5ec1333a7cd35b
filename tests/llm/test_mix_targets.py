"""Small sources beside large ones reach their targets."""

import numpy as np
import pytest

from panelcast.llm import op6_mixing
from tests.llm.test_mix_chat import n_words


@pytest.mark.parametrize("words", [1, 5, 10, 31, 32, 33, 40, 65, 100, 200])
def test_small_sources_reach_their_targets(spark, words):
    rows = [(i, "large", "w " * 50) for i in range(400)] + [(1000 + i, "other", "v " * 37) for i in range(500)]
    rows += [(2000 + i, "small", "u") for i in range(words)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = op6_mixing.mix(docs, ["doc_id", "source"]).collect()
    taken = {s: sum(r.taken for r in found if r.source == s) for s in ("large", "other", "small")}
    target = {r.source: r.target for r in found}
    assert target["small"] == 3 * words
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)


def test_mixed_texts_have_the_words_taken(spark):
    rows = [(i, "a" if i % 3 else "b", " ".join(f"{i}x{j}" for j in range(i % 97))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r.doc_id: r.taken for r in op6_mixing.mix(docs, ["doc_id"]).collect()}
    got = dict.fromkeys(taken, 0)
    for r in op6_mixing.mixed_documents(docs).collect():
        got[r.doc_id] += n_words(r.text)
    assert got == taken


@pytest.mark.parametrize(("words", "turn"), [(1, 0), (31, 0), (32, 0), (33, 1), (500, 7), (1000, 30)])
def test_choice_has_the_words_asked_for(words, turn):
    for extra in {0, 1, words // 3, words - 1}:
        assert op6_mixing.chosen(0, words, words, extra, turn).sum() == extra
        parts = [op6_mixing.chosen(b, min(7, words - b), words, extra, turn) for b in range(0, words, 7)]
        assert np.concatenate(parts).tolist() == op6_mixing.chosen(0, words, words, extra, turn).tolist()
