"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

The merges of a rank file fix, for every prefix of a byte string, one last token.
The encoding of ``u + t`` is that of ``u`` followed by ``t`` exactly when the last
token of ``u`` and ``t`` keep their border when merged on their own.  A state of the
transducer therefore needs only those earlier positions from which some vocabulary
entry could still reach past the bytes read (none is older than the longest entry),
with the last token before each.  A token is emitted once all paths that are still
open run through it.  States and moves are made when first met and kept while they
fit ``max_states``; beyond that all are forgotten and made anew, with the same ids.

Null text is the empty text; it has no ids.  Texts of any length are read whole; long
pre-tokens leave the transducer as they are settled.  Repeated rows, ties and extra
columns pass through unchanged; a new column whose name is taken gets underscores in
front; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, sliced

NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain lowest-rank-first merging; used for short pairs only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Deterministic byte-to-token machine, built as far as the input asks for it.

    A state is a flat tuple (node, token, node, token, ...): one pair for each position
    from which an entry may still reach on, oldest first.  ``node`` is the place in the
    vocabulary's trie of the bytes read since then, ``token`` the last token before it.
    A move yields the token that ends at the byte read.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.entry = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends, self.inner = [NONE], [True]
        for entry, i in ranks.items():
            node = 0
            for byte in entry:
                self.inner[node] = True
                if (down := self.child.get(node << 8 | byte)) is None:
                    down = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(NONE)
                    self.inner.append(False)
                node = down
            self.ends[node] = i
        self.borders: dict[tuple[int, int], bool] = {}
        self.states: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first.  Tables are emptied in place: callers hold on to them in the middle of a piece."""
        for table in (self.states, self.ids, self.moves):
            table.clear()
        self.start = self.intern((0, NONE))

    def intern(self, state: tuple[int, ...]) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
        return k

    def border(self, left: int, right: int) -> bool:
        """Whether two tokens keep their border when merged on their own."""
        if (known := self.borders.get((left, right))) is None:
            if len(self.borders) > self.max_states:
                self.borders.clear()
            known = self.borders[left, right] = left == NONE or merged(self.ranks, self.entry[left] + self.entry[right]) == [left, right]
        return known

    def move(self, at: int, byte: int) -> tuple[int, int]:
        """Make and keep the move from a state; the next state and the token that ends here."""
        state, child, ends, inner = self.states[at], self.child, self.ends, self.inner
        kept, here = [], NONE
        for k in range(0, len(state), 2):
            if (node := child.get(state[k] << 8 | byte)) is not None:
                last = state[k + 1]
                if here == NONE and ends[node] != NONE and self.border(last, ends[node]):
                    here = ends[node]
                if inner[node]:
                    kept += (node, last)
        if here == NONE:
            raise ValueError("the ranks are not a closed set of merges over all bytes")
        kept += (0, here)
        if len(self.states) >= self.max_states:
            self.reset()
            return self.intern(tuple(kept)), here
        step = self.moves[at << 8 | byte] = self.intern(tuple(kept)), here
        return step

    def stream(self, chunks: Iterable[bytes], look: int = 4096) -> Iterator[int]:
        """Token ids of one pre-token that arrives in chunks.

        ``ended`` holds the token that ends at each byte not yet settled.  Whenever
        ``look`` of them wait, the paths back from every position still held are
        followed until they meet; what lies before is settled and leaves.
        """
        at, ended, look_at = self.start, [], look
        for chunk in chunks:
            for byte in chunk:
                at, here = self.moves.get(at << 8 | byte) or self.move(at, byte)
                ended.append(here)
                if len(ended) >= look_at:
                    settled = self._meet(at, ended)
                    yield from self._back(ended, settled)
                    del ended[:settled]
                    look_at = len(ended) + look
        yield from self._back(ended, len(ended))

    def _back(self, ended: list[int], end: int) -> list[int]:
        out, length = [], self.length
        while end > 0:
            out.append(ended[end - 1])
            end -= length[out[-1]]
        return out[::-1]

    def _meet(self, at: int, ended: list[int]) -> int:
        """The last position through which every held path runs."""
        longest = max(self.length.values())
        paths = []
        for end in range(max(0, len(ended) - longest), len(ended) + 1):
            places = {end}
            while end > 0:
                end -= self.length[ended[end - 1]]
                places.add(end)
            paths.append(places)
        return max(set.intersection(*paths), default=0)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a pre-token; one that is an entry itself is that entry."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 4096:
            return list(self.stream((piece,)))
        at, ended, get = self.start, [], self.moves.get
        for byte in piece:
            at, here = get(at << 8 | byte) or self.move(at, byte)
            ended.append(here)
        return self._back(ended, len(ended))


class Encoder:
    """Whole texts to packed ids.  Pre-tokens met before come from a bounded table."""

    def __init__(self, path: str, pattern: str, max_kept: int = 400_000):
        self.ranks = load_ranks(path)
        self.machine = Transducer(self.ranks)
        self.find = regex.compile(pattern).findall
        self.max_kept = max_kept
        self.kept: dict[str, bytes] = {}

    def pack(self, piece: str) -> bytes:
        ids = self.machine.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.kept) >= self.max_kept:
                self.kept.clear()
            self.kept[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, pack = self.kept.get, self.pack
        return b"".join([get(p) or pack(p) for p in self.find(text)])


class Decoder:
    """Ids to text, piece by piece; bytes of an unfinished character wait for the next ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self.reset()

    def reset(self) -> None:
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def bytes(self, ids: Iterable[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.utf8.decode(self.bytes(ids), final)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def _appended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema with more fields at its end; a name that is taken (in any case) gets underscores in front."""
    return T.StructType([*schema.fields, *(T.StructField(free_name(schema.names, n), t) for n, t in fields)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Append ``into`` (array of int), the ids of ``text``."""

    def run(batches):
        made = encoder(path, pattern)
        for batch in sliced(batches):
            packed = [made.packed(t) for t in batch.column(text).to_pylist()]
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], schema.names)

    schema = _appended(docs.schema, (into, T.ArrayType(T.IntegerType())))
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded", step: int = 4096) -> DataFrame:
    """Append ``into`` (string), read back from ``ids`` through the streaming decoder."""

    def run(batches):
        made = decoder(path)
        for batch in sliced(batches):
            texts = []
            for row in batch.column(ids).to_pylist():
                made.reset()
                row = row or []
                texts.append("".join(made.feed(row[k : k + step]) for k in range(0, len(row), step)) + made.feed((), True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    schema = _appended(docs.schema, (into, T.StringType()))
    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", step: int = 4096) -> DataFrame:
    """``encode``, and ``text`` read back from the ids by the streaming decoder, in one pass of one worker."""

    at, schema = docs.columns.index(text), _appended(docs.schema, (into, T.ArrayType(T.IntegerType())))

    def run(batches):
        made, back = encoder(path, pattern), decoder(path)
        for batch in sliced(batches):
            packed = [made.packed(t) for t in batch.column(at).to_pylist()]
            texts, ends = [], [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
                read = memoryview(p).cast("I")
                back.reset()
                texts.append("".join([back.feed(read[k : k + step]) for k in range(0, len(read), step)]) + back.feed((), True))
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :], ids], schema.names)

    return docs.mapInArrow(run, schema)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", step: int = 65_536) -> DataFrame:
    """Per row: key, token count, digest of the packed ids and of the bytes decoded from them again."""

    def run(batches):
        made, back = encoder(path, pattern), decoder(path)
        for batch in sliced(batches):
            counts, ids, decoded = [], [], []
            for t in batch.column(text).to_pylist():
                packed = made.packed(t)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                digest, read = hashlib.sha256(), memoryview(packed).cast("I")
                back.reset()
                for k in range(0, len(read), step):
                    digest.update(back.feed(read[k : k + step]).encode())
                digest.update(back.feed((), True).encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {DIGESTS}")
