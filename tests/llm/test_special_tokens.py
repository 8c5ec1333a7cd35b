"""Names of special tokens in texts, against the tokenizers' own default call."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelcast.llm import op1_token_codes, op7_packing, tokens

TEXTS = [
    "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b<|endoftext|>", "It's <|startoftext|>\n\n The end. <|endoftext|>\n",
    "<|ENDOFTEXT|> hello", "A<|EndOfText|>b", "<|StartOfText|>", "<|endoftext |> <| endoftext|>", "hello <|endoftext|", "plain text",
]


def default_ids(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_reads_names_of_special_tokens(name, spaces):
    encoder = tokens.Encoder(public_tokenizers.path(name), spaces)
    for texts in (TEXTS, TEXTS[::-1]):
        assert [tokens.ids(p).tolist() for p in encoder.encode(texts)] == [default_ids(name, t) for t in texts]


def test_codes_and_packing_read_names_of_special_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    op1_token_codes.write(docs, str(tmp_path / "codes"))
    codes = {r.doc_id: r for r in op1_token_codes.read(spark, str(tmp_path / "codes")).collect()}
    pieces = {r.doc_id: r for r in op7_packing.pack(docs).where("start = 0 and length = doc_tokens").collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        wanted = [*default_ids("word_bpe_49k.json", text), op1_token_codes.END_ID]
        assert (codes[i].start, np.frombuffer(codes[i].ids, "<u4").tolist()) == (start, wanted)
        assert np.frombuffer(pieces[i].ids, "<u4").tolist() == [*default_ids("byte_bpe_50k.json", text), op7_packing.END_ID]
        start += len(wanted)


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("names", [True, False])
def test_split_texts_are_encoded_like_whole_ones(name, spaces, names):
    """Random white space between and around words and marks; small caches are emptied on the way."""
    rng = random.Random(7)
    parts = ["word", "It's", "don't,", "x²", "(a)", "..", "é", "漢字", "12", "W" * 60, "\U0001f600", "<|endoftext|>", "_a_", "'ll"]
    space = [" ", " ", " ", "\n", "  ", "\t", " \n", "\n ", "\r\n", "\n\n", "   ", "", "\xa0"]
    texts = ["".join(rng.choice(parts) + rng.choice(space) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += [rng.choice(space) + t for t in texts[:300]]
    encoder = tokens.Encoder(public_tokenizers.path(name), spaces, names=names, remembered=50)
    for start in range(0, len(texts), 100):
        some = texts[start : start + 100]
        assert encoder.encode(some) == encoder.direct(some)
