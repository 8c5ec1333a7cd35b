"""Token ids of whole texts, with a bounded cache of words.

Both public tokenizers cut a text at white space, and where letters, digits and marks meet, before
they merge anything, so a piece between two such places has the same ids anywhere. A slice of texts is
cut by class of byte in numpy, its pieces are dictionary-encoded by Arrow, and only distinct
pieces are looked up; the ids of all pieces are then gathered at once, without a Python object
per word. New pieces go through the tokenizer many at a time, joined to one text whose ids show
where a word ends. Next to letters beyond ASCII there is a cut only where the letter is known by its
first byte. Texts with white space other than blank, tab and line ends, or with the name of a special
token, which stands for that token, are encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from panelcast.llm import common
from panelcast.llm.flat import Flat, positions

#: Pieces a process remembers, and bytes of them and their ids; the cache is emptied when it is full.
CACHE = 700_000
CACHE_BYTES = 24 << 20
#: Longest word that other caches keep.
LONGEST = 48
#: Words that are encoded as one text.
JOINED = 2000

#: White space with cut rules of its own, and the one letter whose small form is a letter and a mark.
_ODD = "[\x0b\x0c\x1c-\x1f\u0085\u00a0\u0130\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Classes of bytes: space 0, letter 1, digit 2, other ASCII 3, the rest 4.
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[:128] = 3
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_APOSTROPHE = ord("'")
_LINE_END = ord("\n")
#: First bytes of two that spell a letter of the Latin or Cyrillic blocks; of those after 0xC3 two are signs.
_LETTER_LEAD = np.zeros(256, dtype=bool)
_LETTER_LEAD[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True
_SIGNS = (0x97, 0xB7)


def _cuts(data: np.ndarray, edge: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and which bytes are space; ``edge`` marks the first byte of each text."""
    kind = _CLASS[data]
    before, now = kind[:-1], kind[1:]
    # A letter that ends here although its last byte is not ASCII.
    known = before.copy()
    if len(data) > 2 and (kind == 4).any():
        lead, last = data[:-2], data[1:-1]
        ends = _LETTER_LEAD[lead] & ~((lead == 0xC3) & ((last == _SIGNS[0]) | (last == _SIGNS[1])))
        known[1:][ends] = 1
    solid = (known >= 1) & (known <= 3) & (now >= 1) & (now <= 3)
    cut = solid & (known != now) & ~((data[:-1] == _APOSTROPHE) & (now == 1))
    if spaces:
        cut |= (before != 0) & (now == 0)
        # A single line end before a letter stands alone.
        alone = (data[:-1] == _LINE_END) & (now == 1)
        alone[1:] &= before[:-1] != 0
        cut |= alone
    else:
        cut |= (before == 0) != (now == 0)
        cut |= (before == 2) & (now == 2)
    starts = edge.copy()
    starts[1:] |= cut
    return starts, kind == 0


_encoders: dict[tuple[str, bool], Encoder] = {}
common.LEFTOVERS.append(_encoders.clear)


def encoder(path: str, spaces: bool) -> Encoder:
    """The process's encoder for a tokenizer file."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


def ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")


def _grown(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` after its first ``used`` values; room doubles when it is short."""
    need = used + len(new)
    if need > len(held):
        held = np.concatenate([held[:used], np.zeros(max(need, 2 * used) - used, dtype=held.dtype)])
    held[used:need] = new
    return held


class Encoder:
    """``spaces``: white space before a word belongs to its ids; otherwise it is dropped and case is folded.
    ``names``: the name of a special token in a text is that token, else it is plain text. ``remembered``: words kept."""

    def __init__(self, path: str, spaces: bool, names: bool = True, remembered: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not names
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()] if names else []
        self.remembered = remembered
        self.spaces = spaces
        self._forget()
        spelled = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(spelled.values()) + 1, dtype=bool)
        self.opens = np.zeros(len(self.closes), dtype=bool)
        for name, number in spelled.items():
            self.closes[number] = name.endswith("</w>")
            self.opens[number] = name.startswith("\u0120")  # how byte-level vocabularies write a blank
        self.line_end = spelled.get("\u010a", -1)

    def direct(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the tokenizer, little-endian unsigned 32-bit."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _forget(self) -> None:
        """Empty the cache: pieces' numbers, where their ids start, how many there are, and all ids."""
        self.cache: dict[bytes, int] = {}
        self.held = 0
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")
        self.pooled = 0

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are encoded as a whole. The case of a special token's name counts."""
        odd = pa.compute.match_substring_regex(texts, _ODD)
        for name in self.added:
            odd = pa.compute.or_(odd, pa.compute.match_substring(texts, name))
        return np.flatnonzero(odd.to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; a null text has none."""
        found, bounds = self.encode_flat(texts)
        packed = found.tobytes()
        at = (4 * bounds).tolist()
        return [packed[a:b] for a, b in zip(at[:-1], at[1:])]

    def encode_flat(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start, with the end of the last."""
        if len(self.cache) > self.remembered or self.held > CACHE_BYTES:
            self._forget()
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        texts = pa.compute.fill_null(texts, "")
        odd = self._odd(texts)
        if len(odd):
            keep = np.ones(len(texts), dtype=bool)
            keep[odd] = False
            own, ends = self._cut(pa.compute.if_else(pa.array(keep), texts, ""))
            whole = self.direct(texts.take(pa.array(odd)).to_pylist())
            parts = [own[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for i, packed in zip(odd.tolist(), whole):
                parts[i] = ids(packed)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            return np.concatenate(parts), bounds
        return self._cut(texts)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = Flat.of(texts)
        data, n = flat.data, len(flat.data)
        if n == 0:
            return np.zeros(0, dtype="<u4"), np.zeros(flat.rows + 1, dtype=np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[flat.bounds] = True
        starts, space = _cuts(data, edge[:n], self.spaces)
        if self.spaces:
            begin = np.flatnonzero(starts)
            offsets = np.append(begin, n).astype(np.int64)
        else:
            # Case of ASCII is folded; before a letter's mark that is left to the tokenizer.
            fold = _UPPER[data]
            fold[:-1] &= data[1:] < 128
            data = data + (fold.view(np.uint8) << 5)
            solid = ~space
            begin = np.flatnonzero(starts & solid)
            places = np.cumsum(solid)
            offsets = np.append(places[begin] - 1, places[-1]).astype(np.int64)
            data = data[solid]
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), buffers).dictionary_encode()
        codes = pieces.indices.to_numpy()
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        each = numbers[codes]
        sizes = self.sizes[each]
        found = self.pool[positions(self.starts[each], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return found, before[np.searchsorted(begin, flat.bounds)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces in the cache; what it lacks is encoded first."""
        number = self.cache.get
        numbers = np.array([number(p, -1) for p in pieces], dtype=np.int64)
        lacks = np.flatnonzero(numbers < 0)
        if len(lacks):
            missing = [pieces[i] for i in lacks.tolist()]
            found = self._new([p.decode() for p in missing])
            sizes = np.array([len(p) // 4 for p in found], dtype=np.int64)
            new = ids(b"".join(found))
            first = len(self.cache)
            self.starts = _grown(self.starts, first, self.pooled + np.cumsum(sizes) - sizes)
            self.sizes = _grown(self.sizes, first, sizes)
            self.pool = _grown(self.pool, self.pooled, new)
            self.pooled += len(new)
            self.cache.update(zip(missing, range(first, first + len(missing))))
            self.held += sum(map(len, missing)) + 4 * len(new)
            numbers[lacks] = np.arange(first, first + len(missing))
        return numbers

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of different words that the cache lacks."""
        found = self._joined([w for w in words if (w[1:] if w[0] == " " else w).isalpha()])
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self.direct(rest)))
        return [found[w] for w in words]

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters. A joined text whose ids do not show its words is left to the caller."""
        found: dict[str, bytes] = {}
        blank = [w for w in words if w[0] == " "]
        bare = [w for w in words if w[0] != " "]
        for group, glue in ((blank, ""), (bare, "\n" if self.spaces else " ")):
            for start in range(0, len(group), JOINED):
                some = group[start : start + JOINED]
                ids_ = np.array(self.tokenizer.encode(glue.join(some), add_special_tokens=False).ids, dtype="<u4")
                if not self.spaces:
                    ends = np.flatnonzero(self.closes[ids_]) + 1
                    starts = np.concatenate([[0], ends[:-1]])
                elif glue:
                    at = np.flatnonzero(ids_ == self.line_end)
                    starts, ends = np.concatenate([[0], at + 1]), np.append(at, len(ids_))
                else:
                    starts = np.flatnonzero(self.opens[ids_])
                    ends = np.append(starts[1:], len(ids_))
                if len(starts) == len(some):
                    packed = ids_.tobytes()
                    found.update(zip(some, [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]))
        return found
