"""Public tokenizers as exact encoders: words met before are looked up, all others go to the library.

Both JSON files cut a text into words before they merge, so the ids of a text
are those of its words one after another. A text is cut only where the library
must cut too: at every white space for the file that drops it; for the other,
where all white space of the text is single spaces and line ends with other
characters on both sides. Any other text goes to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from voxloom.llm.words import Growing, WordMemory, runs_at

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Encoder:
    """ids of texts by the `tokenizers` library, without added special tokens."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.spaces_matter = self._of("a b") != self._of("a  b")
        self.after = _Pool(self, " " if self.spaces_matter else "")
        self.first = _Pool(self, "") if self.spaces_matter else self.after

    def _of(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Pool and number of each word, or None where no cut is sure. Pool 0
        holds words after a space, 1 line starts, 2 the line end itself."""
        words = text.split()
        if not self.spaces_matter:
            # Python's white space has four control characters more than the library's
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return None
            return np.zeros(len(words), np.int8), self.after.numbers(words)
        if not words or " ".join(words) != text.replace("\n", " "):
            return None
        opens = np.zeros(len(words), bool)
        opens[0] = True
        if "\n" in text:
            lines = [line.count(" ") + 1 for line in text.split("\n")]
            opens[np.cumsum(lines)[:-1]] = True
        at = np.flatnonzero(opens)
        numbers = self.after.numbers(words)
        numbers[at] = self.first.numbers([words[i] for i in at])
        return opens.astype(np.int8), numbers

    def ids(self, text: str) -> np.ndarray:
        parts = self._parts(text)
        if parts is None:
            return self.whole([text])[0] if text else np.empty(0, np.uint32)
        pool, numbers = parts
        if not len(numbers):
            return np.empty(0, np.uint32)
        opens = pool == 1
        if not opens.any():
            return self.after.ids(numbers)
        lengths = np.where(opens, 0, self.after.lengths_of(np.where(opens, 0, numbers)))
        at = np.flatnonzero(opens)
        lengths[at] = self.first.lengths_of(numbers[at])
        line_end = self.line_end
        gap = opens.astype(np.int64) * len(line_end)
        gap[0] = 0
        out = np.empty(int(lengths.sum() + gap.sum()), np.uint32)
        to = np.cumsum(lengths + gap) - lengths
        rest = np.flatnonzero(~opens)
        out[runs_at(to[rest], lengths[rest])] = self.after.ids(numbers[rest])
        out[runs_at(to[at], lengths[at])] = self.first.ids(numbers[at])
        for k, i in enumerate(line_end):
            out[to[at[1:]] - len(line_end) + k] = i
        return out

    @property
    def line_end(self) -> list[int]:
        if not hasattr(self, "_line_end"):
            self._line_end = self._of("\n")
        return self._line_end

    def count(self, text: str) -> int:
        parts = self._parts(text)
        if parts is None:
            return len(self.whole([text])[0]) if text else 0
        pool, numbers = parts
        if not len(numbers):
            return 0
        at = np.flatnonzero(pool == 1)
        rest = numbers[pool == 0]
        total = int(self.after.lengths_of(rest).sum()) if len(rest) else 0
        if len(at):
            total += int(self.first.lengths_of(numbers[at]).sum()) + (len(at) - 1) * len(self.line_end)
        return total


class _Pool:
    """The ids of words that follow `before`."""

    def __init__(self, encoder: Encoder, before: str):
        self.encoder, self.before = encoder, before
        self.flat, self.starts, self.sizes = Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        self.memory = WordMemory(self._learn, self._forget)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 5_000):
            new = [self.before + w for w in words[at : at + 5_000]]
            found = [e.ids for e in self.encoder.library.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts.extend(self.flat.size + np.cumsum(sizes) - sizes)
            self.sizes.extend(sizes)
            self.flat.extend(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))

    def _forget(self) -> None:
        for x in (self.flat, self.starts, self.sizes):
            x.clear()

    def numbers(self, words: list[str]) -> np.ndarray:
        return self.memory.numbers(words)

    def lengths_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.sizes.values[numbers]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat.values[runs_at(self.starts.values[numbers], self.sizes.values[numbers])]


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(name)
