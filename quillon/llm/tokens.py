"""Whole-text token ids by a public tokenizer, with each worker's words encoded once.

The vocabulary's pre-tokenizer drops white space and never joins across it, and always ends a run of letters before
punctuation. So a text's ids are those of its words end to end, and a word's ids those of its letters and of the
punctuation that closes it. Words repeat, so a worker keeps the ids of those that it has met. A-Z are lowered first, as the
tokenizer would, but not in words with ``<|``: these may hold special tokens, which it looks for in the raw text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from quillon.llm.common import LOWER, spread, take_words, text_bytes, word_spans

#: Letters of which each is one character in normal form, with one lower-case letter.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
CLOSING = b".,!?;:"
MOST_WORDS = 400_000
_kept: dict[str, "WordEncoder"] = {}


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write byte b as a printable character: itself where it is printable, else one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}  # a word's ids, four bytes each

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """This worker's encoder."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        slow = []
        for word in words:
            text = word.decode("utf-8", "replace").lower()
            if PLAIN.fullmatch(text):
                plain = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
                self.known[word] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
            else:
                slow.append(word)
        for word, ids in zip(slow, self._encode([w.decode("utf-8", "replace") for w in slow])):
            self.known[word] = array("I", ids).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end (uint32), and the offsets of the texts."""
        raw, offsets = text_bytes(column)
        data = LOWER[raw]
        begin, end, words_before = word_spans(data, offsets)
        if len(marks := np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))):  # "<|"
            special = np.unique(np.searchsorted(begin, marks, side="right") - 1)
            own = spread(begin[special], end[special] - begin[special])
            data[own] = raw[own]
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        closing = np.zeros(256, bool)
        closing[list(CLOSING)] = True
        letter = np.zeros(256, bool)
        letter[97:123] = letter[65:91] = True
        # split off what closes a word, where a letter stands before it
        body = end.copy()
        while True:
            cutable = (body - begin > 1) & closing[data[body - 1]]
            if not cutable.any():
                break
            body[cutable] -= 1
        last, lead = data[body - 1], data[np.maximum(body - 2, 0)]
        latin = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (body - begin > 1)  # U+00C0 to U+00FF but the two signs
        body = np.where(letter[last] | latin, body, end)
        both = np.empty(2 * len(begin), np.int64), np.empty(2 * len(begin), np.int64)
        both[0][0::2], both[1][0::2], both[0][1::2], both[1][1::2] = begin, body, body, end
        full = both[0] < both[1]
        parts_before = np.concatenate([[0], np.cumsum(full)])[2 * words_before]
        coded = take_words(data, both[0][full], both[1][full]).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if fresh := [w for w in distinct if w not in self.known]:
            self._learn(fresh)
        lists = [self.known[w] if w in self.known else self._again(w) for w in distinct]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), np.uint32)
        starts = np.cumsum(sizes) - sizes
        ids = flat[spread(starts[codes], sizes[codes])]
        return ids, np.concatenate([[0], np.cumsum(sizes[codes])])[parts_before]

    def _again(self, word: bytes) -> bytes:
        self._learn([word])
        return self.known[word]


def count_tokens(column: pa.Array, path: str) -> np.ndarray:
    return np.diff(WordEncoder.of(path).encode(column)[1])


def words_in(column: pa.Array) -> np.ndarray:
    """White-space words of each text; null has none."""
    return np.diff(word_spans(*text_bytes(column))[2])


__all__ = ["WordEncoder", "count_tokens", "words_in"]
