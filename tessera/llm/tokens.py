"""Words of whole batches of texts as 64-bit hashes, without an object for each word.

A word is a maximal run of bytes that are not ASCII white space.  Its hash is a
polynomial over a random value for each byte, taken from running sums, so each byte
costs a few array operations.  Texts are read in chunks that end between words; only
a word longer than a chunk makes one longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes whose running sums are held at once; half a MB of sums stays in a core's own cache.
CHUNK = 1 << 16
BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


_POWERS = Powers(BASE)
_BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and the border of each; null is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, borders, data = texts.buffers()
    borders = np.frombuffer(borders, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def line_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number from 0, start and end of every line, empty ones too."""
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, borders)) + 1
    doc = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    starts, ends, first = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64), number == 0
    last = np.append(first[1:], True)[: len(doc)]
    starts[first], starts[~first] = borders[:-1], breaks + 1
    ends[last], ends[~last] = borders[1:], breaks
    return doc, number, starts, ends


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans, one after the other, and their borders."""
    borders = np.concatenate(([0], np.cumsum(ends - starts)))
    return data[np.arange(borders[-1]) + np.repeat(starts - borders[:-1], ends - starts)], borders


class Words:
    """``starts`` and ``ends`` in ``data``, the text ``doc`` and the ``hashes`` of all words of some texts, or of bytes and their borders."""

    def __init__(self, texts: pa.Array | tuple[np.ndarray, np.ndarray]):
        self.data, self.borders = data, borders = texts if isinstance(texts, tuple) else text_bytes(texts)
        n = len(data)
        solid = (data != 32) & (data - np.uint8(9) > 4)
        cut = np.zeros(n + 1, bool)
        cut[borders] = True
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | cut[1:n]
        stops[:-1] &= ~solid[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        #: Words of each text.
        self.sizes = np.diff(np.searchsorted(self.starts, borders))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, at = np.empty(len(self.starts), U), 0
        while at < len(self.starts):
            low = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            high = self.ends[upto - 1]
            up, down = _POWERS.upto(int(high - low) + 1)
            sums = np.zeros(int(high - low) + 1, U)
            values = _BYTE.take(self.data[low:high], mode="clip")  # bytes are never out of bounds; this mode doesn't look
            np.multiply(values, up[:-1], out=values)
            np.cumsum(values, dtype=U, out=sums[1:])
            s, e = self.starts[at:upto] - low, self.ends[at:upto] - low
            out[at:upto] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            at = upto
        return out

    def lines(self) -> np.ndarray:
        """The line of its text that each word stands in, from 0."""
        breaks = np.flatnonzero(self.data == 10)
        first = np.searchsorted(self.starts, np.append(breaks, len(self.data)))
        line = np.repeat(np.arange(len(first)), np.diff(first, prepend=0))
        return line - np.searchsorted(breaks, self.borders[:-1])[self.doc]

    def joined(self, which: np.ndarray) -> bytes:
        """The words picked by a mask over all words, joined by spaces."""
        data, view = [], memoryview(self.data)
        for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist()):
            data.append(view[s:e])
        return b" ".join(data)
