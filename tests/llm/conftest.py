import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside must not meet those of extra columns.
        *[T.StructField(n, T.StringType()) for n in ("id", "key", "size", "begin", "rank", "spans", "kept", "score", "row")],
    ]
)


def sentence(rng: random.Random, words: int) -> str:
    syllables = ["ba", "co", "di", "fu", "ge", "ho", "ki", "lu", "me", "no", "pa", "ri"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    base = sentence(rng, 160)
    words = base.split()
    edited = " ".join(words[:80] + ["changed"] + words[81:])
    far = " ".join(w if i % 9 else f"other{i}" for i, w in enumerate(words))
    passage = sentence(rng, 60)
    texts = [
        (0, base, "en", "a"),
        (1, None, None, None),
        (2, "", "en", "b"),
        (3, " \t\n ", "fr", "b"),
        (4, base, "en", None),
        (5, edited, "en", "a"),
        (6, far, "fr", "a"),
        (7, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 20), "fr", "c"),
        (8, passage + " " + sentence(rng, 40), "en", "c"),
        (9, "Two words", "en", "d"),
        (10, "TWO WORDS", "en", "d"),
        (11, "one", "en", "d"),
        (12, "<|endoftext|> it's 12,5€ — ½ x²  \n\n tab\t\ttab  ", "en", "e"),
        (13, "a" * 300, "en", "e"),
        (14, ("same line of words here\n" * 40) + base, "en", "a"),
        (15, "ÇA déjà vu " * 70, "fr", "e"),
        (16, sentence(rng, 6000), "en", "a"),
        (17, sentence(rng, 3) + " \U0001f600 漢字 " * 30, "fr", "a"),
        (None, sentence(rng, 70), "en", "a"),
        (None, base, None, "z"),
        (18, "### </turn> 12345 ???", None, "b"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), *["x"] * 9) for i, t, lang, source in texts]
    return [*rows, rows[7]]  # one row twice


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def sf_of(tmp_path):
    """Write tables and give their folder to a query."""

    def write(**tables) -> str:
        for name, table in tables.items():
            table.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
