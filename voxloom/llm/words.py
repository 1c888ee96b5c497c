"""A worker's memory of words: each is numbered once, and what is costly to know of it is worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Numbered(dict):
    """Gives a word that is not in it the next number, and lists it as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordMemory:
    """Numbers words from 0 on. `learn` is called with each list of words that
    are new, in the order of their numbers; `forget` before the memory starts
    anew, which it does past `most` words, so a worker's memory is bounded."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int = 600_000):
        self.learn, self.forget, self.most = learn, forget, most
        self.number = _Numbered()

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        if len(number) > self.most:
            number.clear()
            self.forget()
        found = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if number.fresh:
            fresh, number.fresh = number.fresh, []
            self.learn(fresh)
        return found


class Growing:
    """A one-dimensional array that grows by doubling."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.held):
            held = np.empty(max(need, 2 * len(self.held)), self.held.dtype)
            held[: self.size] = self.held[: self.size]
            self.held = held
        self.held[self.size : need] = more
        self.size = need

    def clear(self) -> None:
        self.size = 0

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.size]


def runs_at(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
