"""Token codes and packing against direct encoding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import op1_token_codes, op7_packing, tokens


def direct(name, text, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_encoding_is_direct_encoding(name, spaces):
    texts = [
        "", " ", "\n\n", "a  b\n\n c\t\td ", "It's WE'LL don't'", "x², ½!! (((a))) ...b", "a  b \n\nc \x0b d\x1c!",
        "<|endoftext|>", "é é Å ﬁ İstanbul ΣΑΣ", "漢字かな 😀😀 a" * 3, "w" * 200 + ", " + "v" * 60 + "!", "tab\t", "a \r\n b", "__x__ 1,000.5%",
    ]
    encoder = tokens.encoder(public_tokenizers.path(name), spaces)
    for _ in range(2):
        assert [tokens.ids(p).tolist() for p in encoder.encode(texts)] == [tokens.ids(p).tolist() for p in encoder.direct(texts)]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_encoding_of_random_texts(name, spaces):
    rng = random.Random(1)
    alphabet = [*"abcXYZ\u00e9\u00c9\u00df\u0130\u03c3\u03010 12 .,'\u2019!\n\n  \t\r-_\u00b2\u00bd\u6f22#(<|>)"]
    alphabet += ["\n\n", "  ", " the", " The,", "'s", "n't ", "\xa0", "\x1c"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(8000)]
    encoder = tokens.encoder(public_tokenizers.path(name), spaces)
    for start in range(0, len(texts), 1000):
        some = texts[start : start + 1000]
        assert encoder.encode(some) == encoder.direct(some)


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cuts_next_to_letters_beyond_ascii(name, spaces):
    """Letters known by their first byte, signs among them, marks to be composed, control characters, Hangul, digits."""
    rng = random.Random(3)
    alphabet = [*"aWwI\u00c5\u00d7\u00f7\u00ff\u0130\u01c4\u023a\u0416\u0451\u0483\u0391\u0660\u1100\u1161\uac00\ufb01"]
    alphabet += [*"\u030a\u0307\u0338<=>''19.,-_ \n\t\x00\x1b\x7f", "'s", "\n ", "\r\n", "\U0001f600", "\u212a"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(20_000)]
    encoder = tokens.Encoder(public_tokenizers.path(name), spaces, remembered=5000)
    for start in range(0, len(texts), 2000):
        some = texts[start : start + 2000]
        assert encoder.encode(some) == encoder.direct(some)


def test_very_long_words_do_not_stay():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    texts = ["ab" * 10, None, "x1" * (tokens.CACHE_BYTES // 4), "ab" * 10]
    found = encoder.encode(pa.array(texts))
    assert found[0] == found[3] == encoder.direct(texts[:1])[0] and found[1] == b""
    assert len(found[2]) == 4 * 2 * (tokens.CACHE_BYTES // 4)
    letters = "".join(random.Random(1).choices("abcdefgh", k=3000)) * 100
    encoder.held = tokens.CACHE_BYTES + 1
    assert encoder.encode([letters]) == encoder.direct([letters]) and len(encoder.cache) == 1


@pytest.mark.parametrize("top", [1, 255, 256, 50_000, 2**24, 2**32 - 1])
def test_codes_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 5000):
        values = rng.integers(0, top, n, endpoint=True).astype(np.uint32)
        chunks, bitmaps, ranks = op1_token_codes.pack(values)
        assert op1_token_codes.unpack(chunks, bitmaps).tolist() == values.tolist()
        for place in {0, n // 2, n - 1} if n else ():
            assert op1_token_codes.token_at(chunks, bitmaps, ranks, place) == values[place]


def test_codes_of_edge_cases(edge, spark, tmp_path):
    op1_token_codes.write(edge, str(tmp_path / "codes"), block_ids=100)
    rows = op1_token_codes.read(spark, str(tmp_path / "codes")).collect()
    order = sorted(edge.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    expected, start = [], 0
    for r in order:
        ids = direct("word_bpe_49k.json", r.text, 2)
        expected.append((r.doc_id, start, len(ids), ids.tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows), key=lambda x: x[1]) == expected


def test_look_up_of_places(edge, spark, tmp_path):
    """Every id of every document by key and place, wishes repeated and out of range, a null key."""
    path = str(tmp_path / "codes")
    op1_token_codes.write(edge, path, block_ids=100)
    whole = {r.start: r for r in op1_token_codes.read(spark, path).collect()}
    assert all(r.last_id == op1_token_codes.END_ID for r in whole.values())
    wishes = [(r.doc_id, p) for r in whole.values() for p in (-1, 0, r.n_tokens // 2, r.n_tokens - 1, r.n_tokens, 10**9)]
    wanted = spark.createDataFrame([*wishes, *wishes, (-77, 0), (1, None)], "doc_id long, place long").withColumn("id", F.lit("x"))
    found = op1_token_codes.look_up(wanted, path).collect()
    asked = {(key, place) for key, place in wishes}
    expected = {
        (r.doc_id, p, r.start, int(np.frombuffer(r.ids, "<u4")[p]))
        for r in whole.values() for p in range(r.n_tokens) if (r.doc_id, p) in asked
    }
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_codes_of_nothing(nothing, spark, tmp_path):
    op1_token_codes.write(nothing, str(tmp_path / "codes"))
    assert op1_token_codes.read(spark, str(tmp_path / "codes")).collect() == []
    wanted = spark.createDataFrame([(1, 0)], "doc_id long, place long")
    assert op1_token_codes.look_up(wanted, str(tmp_path / "codes")).collect() == []


def check_packing(rows, docs, window):
    """Every id in one piece, no gaps, full sequences but one."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, texts in docs.items():
        wanted = sorted(direct("byte_bpe_50k.json", t, 0).tobytes() for t in texts)
        if len(texts) == 1:
            pieces = sorted(by_doc[key], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == wanted[0]
            assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
            assert {r.doc_tokens for r in pieces} == {len(wanted[0]) // 4}
        assert sum(r.length for r in by_doc[key]) == sum(map(len, wanted)) // 4
    short = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= window
        short += end < window
    assert short <= 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [16, 64, 1024])
def test_packing_of_edge_cases(edge, window):
    docs = defaultdict(list)
    for r in edge.collect():
        docs[r.doc_id].append(r.text)
    check_packing(op7_packing.pack(edge, window=window).collect(), docs, window)


def test_packing_of_nothing(nothing):
    assert op7_packing.pack(nothing).collect() == []


def test_digest_query(edge, sf_of, spark):
    texts = {r.doc_id: r.text for r in edge.collect()}
    for r in op7_packing.query(spark, sf_of(documents=edge)).collect():
        if r.doc_id is not None:
            ids = direct("byte_bpe_50k.json", texts[r.doc_id], 0)[r.start : r.start + r.length]
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(3))
def test_plan_covers_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = rng.poisson(30, 64).astype(np.int64)
    histogram[[0, 40 + seed]] = [0, 3000]  # one hot length
    plan = op7_packing.plan(histogram, 64)
    lengths = np.repeat(np.arange(64), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram])
    row, start, length, sequence, offset = op7_packing.place(plan, lengths, ranks, 64)
    used = np.zeros((plan.sequences, 64), dtype=int)
    for s, o, n in zip(sequence, offset, length):
        used[s, o : o + n] += 1
    assert used.max() == 1 and (used.sum(axis=1) < 64).sum() <= 1
    assert np.bincount(row, weights=length).tolist() == lengths.tolist()


def test_least_squares_finds_an_exact_solution():
    lengths = np.array([10, 22, 32, 40, 54])
    combos = op7_packing.combinations(lengths, 64)
    assert {tuple(c) for c in combos.tolist()} == {(10, 22, 32), (0, 32, 32), (0, 10, 54)}
    histogram = np.zeros(64)
    histogram[[10, 22, 32, 54]] = [30, 10, 50, 20]
    counts = dict(zip(map(tuple, combos.tolist()), op7_packing.least_squares(combos, histogram)))
    assert np.allclose([counts[10, 22, 32], counts[0, 32, 32], counts[0, 10, 54]], [10, 20, 20], atol=0.05)
