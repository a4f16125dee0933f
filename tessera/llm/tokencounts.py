"""Token counts under a unigram model, by dynamic programming over a shared trie.

A batch's distinct pre-tokens are visited as a trie, in byte order: the forward scores
of a prefix are computed once and stay on a stack while keys go on with it.  Each key
keeps its terminal count, the pieces of its best segmentation (fewest, of equally good
ones).  The model's pieces are the entries of a public rank file; their
probabilities follow their rank by Zipf's law, single bytes ranking last, so that they
serve as a fallback.

Null text is the empty text, with no tokens.  Texts of any length are read whole; a
pre-token of more than ``LONG`` bytes shares no prefix and keeps only the pieces that are
open, so memory does not grow with it.  Repeated rows are counted alike; an empty table
gives an empty result; only the key and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import load_ranks
from .common import sliced


#: Bytes beyond which a pre-token is counted for itself, and not kept.
LONG = 1024


def log_probabilities(ranks: dict[bytes, int], shift: float = 2.7) -> dict[bytes, float]:
    """Zipf-Mandelbrot by rank; single bytes come after all others."""
    order = sorted(ranks, key=lambda b: (len(b) == 1, ranks[b]))
    total = math.log(sum(1 / (k + shift) for k in range(len(order))))
    return {b: -math.log(k + shift) - total for k, b in enumerate(order)}


class SharedTrie:
    def __init__(self, scores: dict[bytes, float]):
        self.child: dict[int, int] = {}
        self.score: list[float | None] = [None]
        self.inner: list[bool] = [True]
        for piece, score in scores.items():
            node = 0
            for byte in piece:
                self.inner[node] = True
                if (down := self.child.get(node << 8 | byte)) is None:
                    down = self.child[node << 8 | byte] = len(self.score)
                    self.score.append(None)
                    self.inner.append(False)
                node = down
            self.score[node] = score

    def step(self, held: list[tuple[int, float, int]], byte: int) -> tuple[list[tuple[int, float, int]], int]:
        """The open pieces after one more byte, and minus the count of the best segmentation up to it."""
        child, score, inner = self.child, self.score, self.inner
        open_, top, count = [], -math.inf, 0
        for node, s, n in held:
            if (node := child.get(node << 8 | byte)) is not None:
                piece = score[node]
                if piece is not None and ((v := s + piece) > top or (v == top and n - 1 > count)):
                    top, count = v, n - 1
                if inner[node]:
                    open_.append((node, s, n))
        open_.append((0, top, count))
        return open_, count

    def alone(self, key: bytes) -> int:
        """The count of one key, holding no more than the pieces open at one byte."""
        held, count = [(0, 0.0, 0)], 0
        for byte in key:
            held, count = self.step(held, byte)
        return -count

    def counts(self, keys: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """Keys in byte order, with their counts.

        ``held[d]``: the pieces still open after ``d`` bytes, as (node, score and minus
        count of the best segmentation before the piece).
        """
        held: list[list[tuple[int, float, int]]] = [[(0, 0.0, 0)]]
        best: list[int] = [0]
        last = b""
        for key in sorted(keys):
            same = 0
            for x, y in zip(last, key):
                if x != y:
                    break
                same += 1
            del held[same + 1 :], best[same + 1 :]
            for byte in key[same:]:
                open_, count = self.step(held[-1], byte)
                held.append(open_)
                best.append(-count)
            last = key
            yield key, best[-1]


class Counter:
    """Pre-tokens to counts, of a bounded number of them."""

    def __init__(self, path: str, pattern: str, max_kept: int = 600_000):
        self.trie = SharedTrie(log_probabilities(load_ranks(path)))
        self.find = regex.compile(pattern).findall
        self.kept: dict[str, int] = {}
        self.max_kept = max_kept

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        found = [self.find(t) if t else [] for t in texts]
        new = set().union(*found) - self.kept.keys()
        if len(self.kept) + len(new) > self.max_kept:
            self.kept.clear()
            new = set().union(*found)
        long = {x for x in new if len(x) > LONG}
        self.kept.update((k.decode(), n) for k, n in self.trie.counts(x.encode() for x in new - long))
        self.kept.update((x, self.trie.alone(x.encode())) for x in long)
        get = self.kept.__getitem__
        out = [(len(f), sum(map(get, f))) for f in found]
        for x in long:
            del self.kept[x]
        return out


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    """One for each Python worker."""
    return Counter(path, pattern)


def count(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_pretokens`` and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path, pattern)
        for batch in sliced(batches):
            found = made.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], [key, "n_pretokens", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_pretokens long, n_tokens long")
