"""Token alignment against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest_texts import edge_texts
from panelcast.llm import common, op12_alignment

SF = "/root/testdata/sf0.001"
FIRST, SECOND = (public_tokenizers.path(n) for n in (op12_alignment.FIRST, op12_alignment.SECOND))


class Plain:
    """Both tokenizers called directly, a text at a time."""

    def __init__(self):
        self.first = Tokenizer.from_file(FIRST)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        letters = op12_alignment.byte_letters()
        self.a = {v: bytes(letters[c] for c in k) for k, v in self.first.get_vocab(with_added_tokens=False).items()}

    def b(self, i):
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(self, ids, spell):
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(spell(i)), i))
            at += len(spell(i))
        return found

    def links(self, text):
        if not text:
            return [], [], [], []
        a = self.ranges(self.first.encode(" " + text, add_special_tokens=False).ids, self.a.__getitem__)
        b = self.ranges(self.second.encode(text), self.b)
        whole = (" " + text).encode()
        if any(b"".join(spell(i) for *_, i in side) != whole for side, spell in ((a, self.a.__getitem__), (b, self.b))):
            return [], [], [], []
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, start = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in (a, b)))
            start = end
        return a, b, links, groups


def brute(rows):
    plain, documents, counts = Plain(), [], Counter()
    for key, text in rows:
        documents.append((key, *plain.links(text)))
        counts.update(set(documents[-1][3]))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return sorted(
        (
            (
                key, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[0]] for x in links),
                sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for key, a, b, links, groups in documents
        ),
        key=str,
    )


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pieces_are_the_model_s():
    pieces = op12_alignment.Pieces(SECOND)
    assert pieces.cuts
    rng = random.Random(3)
    texts = edge_texts() + ["".join(rng.choices(" \n\tabé漢.▁<|x \U0001f600\x00", k=rng.randint(1, 60))) for _ in range(300)]
    for _ in range(2):
        assert pieces.encode(texts) == pieces.direct(texts)


def test_first_ids_are_plain_text():
    encoder = op12_alignment.aligner(FIRST, SECOND).first
    texts = [" <|endoftext|>", " a<|endoftext|>b c <|endoftext|>", " x"]
    plain = Plain().first
    assert [np.frombuffer(p, dtype="<u4").tolist() for p in encoder.encode(texts)] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts
    ]


@pytest.mark.parametrize("small", [{}, {"records": 300, "documents": 4, "at_once": 2, "share": 200}])
def test_edge_cases(edge, spark, small):
    """Nulls, empty texts, special names, the mark of the second side, equal rows; also with many runs and levels of merges."""
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(edge_texts())], "doc_id long, text string")
    docs = edge.unionByName(more, allowMissingColumns=True)
    # One very long text goes through in one piece; the brute version is quadratic, so it stays out here.
    docs = docs.where("text is null or length(text) < 8000")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(op12_alignment.align(docs, **small)) == want


def test_long_text_and_documents_of_the_tables(spark):
    docs = common.table(spark, SF, "documents").where("length(text) < 6000")
    assert found(op12_alignment.align(docs, records=20_000)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400_000))
    rows = found(op12_alignment.align(spark.createDataFrame([(1, long), (2, "a b"), (3, None)], "doc_id long, text string")))
    assert rows[0][1] > 400_000 and rows[0][4] >= rows[0][3] and rows[1][1:4] == (2, 2, 2) and rows[2][1:] == (0, 0, 0, 0, 0, 0, "")


def test_query(spark):
    rows = op12_alignment.query(spark, SF).collect()
    assert len(rows) == common.table(spark, SF, "documents").count()
    assert rows[0].asDict().keys() >= {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


def test_empty_table(nothing, spark, sf_of):
    assert op12_alignment.query(spark, sf_of(documents=nothing)).collect() == []


def test_merge_counts_equal_pairs():
    runs = [(np.array(k, dtype=np.uint64), np.array(n)) for k, n in (([1, 5, 9], [1, 2, 3]), ([5, 70000], [4, 1]), ([], []))]
    assert list(op12_alignment.merged(runs)) == [(1, 1), (5, 6), (9, 3), (70000, 1)]
    pairs = np.array([1, 5, 9, 65536, 65540], dtype=np.uint64)
    assert op12_alignment.highest(pairs, np.array([1, 6, 6, 2, 1])).tolist() == [False, True, True, True, False]
