"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, taken in numpy over whole batches of texts,
tell which characters lie inside n-grams and lines that the text had before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.flat import Flat, Words, mix

#: Largest share of word characters inside repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 50
REPEAT_WORDS = 3

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ngram_coverage array<double>, line_coverage double, base_failed boolean, kept boolean"
)


def _repeats(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: does its (owner, key) occur twice or more, and did it occur before."""
    joint = mix(keys ^ mix(owners.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    ordered = joint[order]
    like_left = np.zeros(len(joint), dtype=bool)
    like_left[1:] = ordered[1:] == ordered[:-1]
    like_right = np.zeros(len(joint), dtype=bool)
    like_right[:-1] = like_left[1:]
    twice, before = np.zeros(len(joint), dtype=bool), np.zeros(len(joint), dtype=bool)
    twice[order] = like_left | like_right
    before[order] = like_left
    return twice, before


def _covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the windows of ``n`` words from ``first``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n, -1)
    return np.cumsum(change[:-1]) > 0


def _sums(weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _lines(flat: Flat, words: Words) -> tuple[np.ndarray, ...]:
    """Start, end, text and whether it has a word, of each line."""
    cut = np.flatnonzero(flat.data == 10)
    starts = np.concatenate([flat.bounds[:-1], cut + 1])
    owners = np.searchsorted(flat.bounds, cut, side="right") - 1
    owners = np.concatenate([np.arange(flat.rows), owners])
    order = np.lexsort((np.arange(len(starts)) >= flat.rows, starts, owners))
    starts, owners = starts[order], owners[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = owners[1:] != owners[:-1]
    ends[last] = flat.bounds[owners[last] + 1]
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    return starts, ends, owners, has_word


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measures of :data:`SCHEMA`, one value per text."""
    flat = Flat.of(texts)
    words = flat.words()
    n_words = words.counts
    char = (flat.data & 0xC0) != 0x80
    chars_before = np.concatenate([[0], np.cumsum(char, dtype=np.int64)])
    lengths = chars_before[words.ends] - chars_before[words.starts]
    word_chars = _sums(lengths, words.bounds)

    starts, ends, owners, has_word = _lines(flat, words)
    starts, ends, owners = starts[has_word], ends[has_word], owners[has_word]
    _, line_before = _repeats(owners, flat.hashes(starts, ends))
    n_dup_lines = np.bincount(owners[line_before], minlength=flat.rows)
    in_lines = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(in_lines, np.searchsorted(words.starts, starts[line_before]), 1)
    np.add.at(in_lines, np.searchsorted(words.starts, ends[line_before]), -1)
    line_chars = _sums(lengths * (np.cumsum(in_lines[:-1]) > 0), words.bounds)

    first, keys = words.windows(REPEAT_WORDS)
    twice, _ = _repeats(words.texts[first], keys)
    repeated = _covered(first[twice], REPEAT_WORDS, len(words.starts))
    n_repeat_words = _sums(repeated, words.bounds)

    base = np.maximum(word_chars, 1)
    coverage = np.zeros((flat.rows, len(NGRAM_LIMITS)))
    # A repeated n-gram holds a repeated trigram at each of its places: only windows that start
    # at one are looked at.
    seen = np.zeros(len(words.starts) + 1, dtype=bool)
    seen[first[twice]] = True
    for column, n in enumerate(NGRAM_LIMITS):
        first, keys = words.windows(n)
        may = seen[first]
        first, keys = first[may], keys[may]
        _, before = _repeats(words.texts[first], keys)
        inside = _covered(first[before], n, len(words.starts))
        coverage[:, column] = _sums(lengths * inside, words.bounds) / base
    line_coverage = line_chars / base
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)
    repetitive = (coverage > np.array(list(NGRAM_LIMITS.values()))).any(axis=1) | (line_coverage > LINE_LIMIT)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _sums(_SYMBOLS[flat.data], flat.bounds),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "ngram_coverage": coverage,
        "line_coverage": line_coverage,
        "base_failed": base_failed,
        "kept": ~base_failed & ~repetitive,
    }


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measures and verdict of every text; one row per row of ``docs``.

    ``ngram_coverage`` holds, for each n of :data:`NGRAM_LIMITS`, the share of word characters
    inside n-grams that occurred earlier in the text, ``line_coverage`` the same for lines.
    A null or empty text has no words and fails. Null and repeated keys are kept as they are;
    other columns are not read. A very long text is measured whole, alone in its slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = measure(common.values(batch, "text"))
            nested = found.pop("ngram_coverage")
            width = nested.shape[1]
            columns = {k: pa.array(v) for k, v in found.items()}
            offsets = pa.array(np.arange(0, nested.size + 1, width, dtype=np.int32))
            columns["ngram_coverage"] = pa.ListArray.from_arrays(offsets, pa.array(nested.ravel()))
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [common.values(batch, "key"), *[columns[n] for n in names]], names=[key, *names]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


#: The verdict of the method is not expressible in SQL; tests hold it against brute force.
ORACLE = None
