"""Many phrases found in one pass over normalised words, with an Aho-Corasick automaton."""

from collections import defaultdict
from collections.abc import Iterable

import ahocorasick
import numpy as np

from vitalcells.llm.textbytes import ALPHANUMERIC, Texts, normalised, words_of


def words_in(text: str | None, is_word: np.ndarray = ALPHANUMERIC) -> list[bytes]:
    """Normalised words of one text."""
    raw = (text or "").encode()
    texts = Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return normalised(texts, words_of(texts, is_word))[0].split()


class Phrases:
    """Phrases of whole words, each with some values."""

    def __init__(self, entries: Iterable[tuple[list[bytes], object]]):
        self.values: list[list] = []
        self.lengths: list[int] = []
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        known: dict[bytes, int] = {}
        grouped: dict[bytes, list] = defaultdict(list)
        for words, value in entries:
            if words:
                grouped[b" ".join(words)].append(value)
        for phrase, values in grouped.items():
            known[phrase] = len(self.values)
            self.values.append(values)
            self.lengths.append(phrase.count(b" ") + 1)
            self._automaton.add_word(phrase.decode("latin-1"), known[phrase])
        self._sizes = np.array([len(p) for p in known], np.int64)
        self._ready = bool(known)
        if known:
            self._automaton.make_automaton()

    def find(self, text: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first word of each place where a phrase's words stand consecutively."""
        if not self._ready or not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.array(list(self._automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        end, phrase = found[:, 0] + 1, found[:, 1]
        start = end - self._sizes[phrase]
        word = np.searchsorted(begins, start)
        bytes_ = np.frombuffer(text, np.uint8)
        whole = (word < len(begins)) & (bytes_[np.minimum(end, len(text) - 1)] <= 0x20)
        whole &= begins[np.minimum(word, len(begins) - 1)] == start
        return phrase[whole], word[whole]
