"""Sets of word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from signalloom.llm.words import U, Texts, Words, grams, lowered, scramble, window_hashes


class Sets:
    """Distinct shingles of each text, as sorted 64-bit hashes: text i has values[bounds[i]:bounds[i + 1]].

    Words are lower-cased (A-Z). A text of fewer words than a shingle has one shingle, all its words; one without
    words has none.
    """

    def __init__(self, column: pa.Array, width: int = 5):
        words = Words(Texts(column))
        tokens = words.hashes(lowered(words.texts.buf))
        g = scramble(grams(tokens, width))
        a, b = words.bounds[:-1].tolist(), words.bounds[1:].tolist()
        found = []
        for i, j in zip(a, b):
            if j - i >= width:
                s = np.sort(g[i : j - width + 1])
                found.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif j > i:
                found.append(scramble(window_hashes(tokens, np.array([i]), j - i) + U(j - i)))
            else:
                found.append(np.zeros(0, U))
        self.bounds = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)
        self.values = np.concatenate(found) if found else np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, U)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit prints of each set, that do not depend on order."""
        n = np.diff(self.bounds).astype(U)
        return scramble(self.sums(scramble(self.values)) + n), scramble(self.sums(scramble(self.values ^ U(0x5851F42D4C957F2D))) ^ n)

    def histograms(self, cells: int) -> np.ndarray:
        """How many shingles of each set fall into each of `cells` cells (a power of two)."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.bounds))
        cell = (self.values & U(cells - 1)).astype(np.int64)
        return np.bincount(owner * cells + cell, minlength=len(self) * cells).reshape(-1, cells)
