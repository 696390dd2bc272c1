"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
#: Bytes hashed at a time; a longer word is hashed by itself.
_BLOCK = 1 << 19

#: White space as the corpus defines it: space, tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=U), np.full(n, U(inverse), dtype=U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POW: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW:
        _POW["p"] = _powers(_BLOCK + 1)
    return _POW["p"]


def scramble(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """Texts of one chunk: buf (all bytes), starts and ends of each text in it. A null text is an empty one."""

    def __init__(self, column: pa.Array):
        data = column.cast(pa.large_binary())
        if isinstance(data, pa.ChunkedArray):
            data = data.combine_chunks()
        offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        base, end = int(offsets[0]), int(offsets[-1])
        body = data.buffers()[2] if len(data) else None
        self.buf = np.frombuffer(body, dtype=np.uint8)[base:end] if body is not None and end > base else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[:-1] - base, offsets[1:] - base
        self.null = np.asarray(data.is_null()) if data.null_count else np.zeros(len(data), bool)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


class Words:
    """Word bounds in texts: starts, ends (byte places) and bounds (text i has words bounds[i] to bounds[i + 1])."""

    def __init__(self, texts: Texts):
        word = ~SPACE[texts.buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = texts.ends > texts.starts
        at = texts.starts[full]
        first[at] = word[at]
        at = texts.ends[full] - 1
        last[at] = word[at]
        self.texts = texts
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, np.append(texts.starts, len(texts.buf)))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.texts)), self.counts())

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words' bytes (of buf, where it replaces the texts' own)."""
        return span_hashes(self.texts.buf if buf is None else buf, self.starts, self.ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and do not overlap."""
    up, down = powers()
    out = np.zeros(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + _BLOCK, side="right"))
        if j <= i:  # one span longer than a block: block by block
            h, e = 0, int(ends[i])
            for k in range(a, e, _BLOCK):
                piece = buf[k : min(k + _BLOCK, e)].astype(U) + U(1)
                h = (h * 0xD6E8FEB86659FD93 + int(np.sum(piece * up[: len(piece)]))) & _MASK
            out[i] = h
            i += 1
            continue
        piece = buf[a : int(ends[j - 1])].astype(U)
        piece += U(1)
        piece *= up[: len(piece)]
        total = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum(piece, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return scramble(out + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def window_hashes(values: np.ndarray, at: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Hashes of the values at every step within `width` from each place in `at`; the caller keeps windows inside a text."""
    h = np.full(len(at), U(width), dtype=U)
    for k in range(0, width, step):
        h = (h ^ values[at + k]) * U(0x9FB21C651E98DF25)
        h ^= h >> U(32)
    return h


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive values (len - width + 1 of them), crossing texts or not."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    h = np.full(n, U(width), dtype=U)
    for k in range(width):
        h ^= values[k : k + n]
        h *= U(0x9FB21C651E98DF25)
        h ^= h >> U(32)
    return h


def chunks(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about `most` bytes; one longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("text").cast(pa.large_binary())
        ends = np.frombuffer(size.buffers()[1], dtype=np.int64)[size.offset : size.offset + batch.num_rows + 1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
