"""Token ids of texts by way of their distinct words: each word is encoded once, texts are gathers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


class WordIds:
    """Encoder of lists of words with a bounded table of the words met so far.

    ``encode_words`` gives the ids of distinct words as one flat array and the number of ids of each. The table is a
    cache of at most about ``most`` words and 16 times as many characters; when it is full it starts anew, which changes no result.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 800_000):
        self.encode_words, self.most = encode_words, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.size = 0
        self.flat, self.starts, self.lens = (np.empty(0, np.int32) for _ in range(3))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        words = list(chain.from_iterable(texts))
        self._add(words)
        ids, lens = self._gather(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        before = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        return ids, before[cuts[1:]] - before[cuts[:-1]]

    def gather(self, words: list, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the sequence ``words[codes]``, and the number of ids of each of its elements; ``words`` are distinct."""
        self._add(words)
        return self._gather(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))[codes])

    def _add(self, words: list) -> None:
        if len(self.index) > self.most or self.size > 16 * self.most:
            self._clear()
        new = list(set(words).difference(self.index))
        if new:
            flat, lens = self.encode_words(new)
            first = len(self.index)
            self.size += sum(map(len, new))
            self.index.update(zip(new, range(first, first + len(new))))
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lens) - lens).astype(np.int32)])
            self.lens = np.concatenate([self.lens, lens.astype(np.int32)])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[codes]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[codes] - ends + lens, lens) + np.arange(total)], lens
