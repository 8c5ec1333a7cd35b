"""Interpolated Kneser-Ney character models of several languages in sorted arrays.

A character n-gram is one 64-bit integer, 16 bits per character, the latest lowest. Per order,
a model holds the sorted n-grams with one log-probability per language, and the sorted
contexts with one back-off weight per language; probabilities are found by binary search.
Characters beyond 16 bits are folded into them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

ORDER = 4
#: N-grams that are scored at once.
CHUNK = 1 << 17
PAD = " " * (ORDER - 1)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` in a sorted table, and which keys are there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    rows = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return rows, table[rows] == keys


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the highest order and where each text's begin; one per character and one for the end."""
    return _grams([PAD + t + " " for t in texts])


def chunks(texts: list[str], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Padded pieces of texts that hold about ``size`` n-grams together, and the numbers of their texts."""
    owners, pieces, held = [], [], 0
    for i, t in enumerate(texts):
        padded = PAD + t + " " if len(t) < size else None
        for start in range(0, len(t) + 1, size):
            if padded is None:
                # Each piece brings the characters before it as context.
                piece = (PAD if not start else "") + t[max(0, start - ORDER + 1) : start + size]
                piece += " " if start + size > len(t) else ""
            else:
                piece = padded
            owners.append(i)
            pieces.append(piece)
            held += len(piece) - ORDER + 1
            if held >= size:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def _grams(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    points = (points ^ ((points >> np.uint64(16)) * np.uint64(40503))) & np.uint64(0xFFFF)
    sizes = np.array([len(t) for t in padded], dtype=np.int64)
    counts = sizes - (ORDER - 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not padded:
        return np.zeros(0, dtype=np.uint64), bounds
    joined = np.zeros(max(0, len(points) - ORDER + 1), dtype=np.uint64)
    for k in range(ORDER):
        joined |= points[k : k + len(joined)] << np.uint64(16 * (ORDER - 1 - k))
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(joined), dtype=bool)
    for k in range(1, ORDER):
        at = starts[1:] - k
        inside[at[at < len(joined)]] = False
    return joined[inside], bounds


@dataclass
class Model:
    """``grams[n]``, ``logs[n]``: n-grams and log-probabilities; ``contexts[n]``, ``backoffs[n]``: for n-gram contexts."""

    languages: list[str]
    unseen: np.ndarray
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoffs: dict[int, np.ndarray] = field(default_factory=dict)

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of the last character of each n-gram, by language."""
        out = np.empty((len(keys), len(self.languages)), dtype=np.float32)
        if order == 0:
            out[:] = self.unseen
            return out
        rows, there = find(self.grams[order], keys)
        out[there] = self.logs[order][rows[there]]
        rest = keys[~there]
        if len(rest):
            lower = self.log_probabilities(rest & _mask(order - 1), order - 1)
            out[~there] = lower + self.backoff(rest >> np.uint64(16), order)
        return out

    def backoff(self, contexts: np.ndarray, order: int) -> np.ndarray:
        rows, there = find(self.contexts[order], contexts)
        out = np.zeros((len(contexts), len(self.languages)), dtype=np.float32)
        out[there] = self.backoffs[order][rows[there]]
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Mean negative log-probability per character, by text and language.

        N-grams are scored in chunks, so memory does not grow with the length of a text.
        """
        total = np.zeros((len(texts), len(self.languages)))
        for owners, pieces in chunks(texts, CHUNK):
            keys, bounds = _grams(pieces)
            logs = self.log_probabilities(keys)
            np.add.at(total, owners, np.add.reduceat(logs, bounds[:-1], axis=0, dtype=np.float64))
        return -total / np.array([len(t) + 1 for t in texts], dtype=np.float64)[:, None]


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def one_language(language: str, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
    """The model of one language from its distinct highest-order n-grams and their counts."""
    order_of_keys = np.argsort(keys)
    keys, counts = keys[order_of_keys], counts[order_of_keys].astype(np.float64)
    levels = {ORDER: (keys, counts)}
    for order in range(ORDER - 1, 0, -1):
        # Lower orders count the different characters before an n-gram.
        distinct, before = np.unique(levels[order + 1][0] & _mask(order), return_counts=True)
        levels[order] = (distinct, before.astype(np.float64))
    model = Model([language], np.full(1, -np.log(alphabet)))
    for order in range(1, ORDER + 1):
        level, count = levels[order]
        discount = _discount(count)
        contexts, first, kinds = np.unique(level >> np.uint64(16), return_index=True, return_counts=True)
        totals = np.add.reduceat(count, first)
        weight = discount * kinds / totals
        lower = np.exp(model.log_probabilities(level & _mask(order - 1), order - 1)[:, 0].astype(np.float64))
        seen = np.repeat(np.arange(len(contexts)), kinds)
        model.grams[order] = level
        model.logs[order] = np.log((count - discount) / totals[seen] + weight[seen] * lower).astype(np.float32)[:, None]
        model.contexts[order] = contexts
        model.backoffs[order] = np.log(weight).astype(np.float32)[:, None]
    return model


def joined(models: list[Model]) -> Model:
    """One model whose tables hold all languages' n-grams, with the value of every language."""
    whole = Model([m.languages[0] for m in models], np.concatenate([m.unseen for m in models]))
    for order in range(1, ORDER + 1):
        whole.grams[order] = np.unique(np.concatenate([m.grams[order] for m in models]))
        whole.contexts[order] = np.unique(np.concatenate([m.contexts[order] for m in models]))
        whole.logs[order] = np.hstack([m.log_probabilities(whole.grams[order], order) for m in models])
        whole.backoffs[order] = np.hstack([m.backoff(whole.contexts[order], order) for m in models])
    return whole
