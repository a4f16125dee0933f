"""Removal of long word sequences that an earlier document has already.

Every run of ``window`` words is an edge between two shorter k-mers in a de Bruijn
graph of the corpus.  Edges of one document that follow each other and have the same
least ``inner``-mer form a nonbranching path as far as that document goes; a path,
not an edge, is the unit that is shuffled.  A first join of paths by their least
inner k-mer finds those met in two documents.  Where all documents agree on the path
around such a k-mer, the whole path is matched at once; where they branch, its edges
are matched one by one.

A match carries the coordinates of both sides: document, digest of its text, first
word.  Matches that follow each other in both documents are compacted by joins with
their successors: one that has no predecessor begins a span, one that has no successor
ends it.  The words of every span are then read again at both coordinates and their
digests compared; a span whose two sides differ is not removed.

Keys of matches are 96 bits of two independent polynomial hashes over word hashes.
Least documents are combined before each shuffle.  Keys of more than ``HOT`` places
are salted, so that no task gets all copies of a passage.  Bitmaps of a fixed size, made
by Spark, only spare work: what they pass in error is matched and found alone.

Null text has no words.  A row with null key neither removes nor loses words.  Rows
with one key count as one document; each row's own words are judged.  Keys are whole
numbers; one that does not cast to one is an error.  A text of any length is read whole.
An empty table gives an empty result.  Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, release, sliced
from .tokens import Powers, U, Words, mixed

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of each fixed-size bitmap (4 MB).
BITS = 1 << 25
EDGE = U(0x5851F42D4C957F2D)
#: Places of a key from which on it is salted, and the parts it is cut into.
HOT, SALTS = 5000, 256
HALF = (1 << 32) - 1

_POWERS = [Powers(b) for b in BASES]


class Spans:
    """Hashes of any span of a word sequence, in constant time each."""

    def __init__(self, hashes: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(hashes) + 1)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(hashes * up[: len(hashes)], dtype=U)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


class Paths:
    """The edges and paths of a batch of texts."""

    def __init__(self, texts: pa.Array, window: int, inner: int):
        self.text = words = Words(texts)
        self.window = window
        self.ends = np.cumsum(words.sizes)
        self.starts = self.ends - words.sizes
        hashes = words.hashes
        n = len(hashes)
        self.doc_of = words.doc
        at = np.flatnonzero(np.arange(n) + window <= self.ends[self.doc_of]) if n >= window else np.zeros(0, np.int64)
        self.first = Spans(hashes, _POWERS[0])
        self.hashes = hashes
        if not len(at):
            self.path_start = self.path_count = np.zeros(0, np.int64)
            self.least = np.zeros(0, U)
            return
        inners = self.first(np.arange(n - inner + 1), np.arange(inner, n + 1))
        # Sliding minimum over the inner k-mers of each edge, by doubling.
        need, have, least = window - inner + 1, 1, inners
        while have < need:
            step = min(have, need - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        begins = np.flatnonzero(new)
        self.path_start = at[begins]
        self.path_count = np.diff(np.append(begins, len(at)))
        self.least = least[begins]

    def path_hashes(self) -> np.ndarray:
        return self.first(self.path_start, self.path_start + self.path_count + self.window - 1)

    def digests(self) -> np.ndarray:
        """32 bits of each text, to tell texts of one key apart."""
        borders, data = self.text.borders.tolist(), memoryview(self.text.data)
        return np.array([xxhash.xxh32_intdigest(data[a:b]) for a, b in zip(borders, borders[1:])], np.int64)

    def keys(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of independent hashes of paths."""
        end = start + count + self.window - 1
        other = Spans(self.hashes, _POWERS[1])
        return self.first(start, end), (other(start, end) >> U(33)).astype(np.int32)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _least_mers(docs: DataFrame, key: str, text: str, window: int, inner: int) -> DataFrame:
    """(m, lo, hi, s_lo, s_hi): by least inner k-mer, the range of its documents and paths, combined by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made = Paths(batch.column(1), window, inner)
            if not len(made.least):
                continue
            doc, path = ids[made.doc_of[made.path_start]], made.path_hashes().view(np.int64)
            order = np.argsort(made.least)
            m = made.least[order]
            first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            doc, path = doc[order], path[order]
            yield pa.RecordBatch.from_arrays([_i64(m[first]), *(pa.array(f.reduceat(x, first)) for x in (doc, path) for f in (np.minimum, np.maximum))], ["m", "lo", "hi", "s_lo", "s_hi"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), text).where("k IS NOT NULL")
    return rows.mapInArrow(run, "m long, lo long, hi long, s_lo long, s_hi long").groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("s_lo").alias("s_lo"), F.max("s_hi").alias("s_hi"))


def bitmap(rows: DataFrame, *where: str) -> list[np.ndarray]:
    """Bitmaps of pmod(v, BITS) over the rows of each condition; Spark sets the bits, at most BITS / 32 words reach the driver."""
    slot = F.pmod(F.col("v"), F.lit(BITS))
    parts = rows.select(F.floor(slot / 32).cast("int").alias("w"), *(F.when(F.expr(c), F.expr(f"shiftleft(1, cast(pmod(v, {BITS}) % 32 as int))")).otherwise(0).alias(f"b{k}") for k, c in enumerate(where)))
    found = parts.groupBy("w").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(len(where)))).toArrow()
    out = []
    for k in range(len(where)):
        bits = np.zeros(BITS // 32, np.int32)
        bits[found.column("w").to_numpy()] = found.column(f"b{k}").to_numpy()
        out.append(bits.view(np.uint32))
    return out


def passed(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.int64) % BITS
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) == 1


def _keyed(docs: DataFrame, key: str, text: str, window: int, inner: int, bits, wanted=None) -> DataFrame:
    """(h, c, doc, at, count, salt): paths around k-mers met in two documents, edges where those branch.

    ``at``: first word in the high half, digest of the text in the low one.  Given the
    bitmaps ``wanted`` of keys that are met and of hot ones, only rows of the first come,
    and those of the second are salted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agreed, branching = bits.value
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made = Paths(batch.column(1), window, inner)
            if not len(made.least):
                continue
            edges = passed(branching, made.least)
            whole = passed(agreed, made.least) & ~edges
            start, count = made.path_start[edges], made.path_count[edges]
            first = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            start = np.concatenate((made.path_start[whole], first))
            count = np.concatenate((made.path_count[whole], np.ones(len(first), np.int64)))
            if not len(start):
                continue
            h, c = made.keys(start, count)
            h[int(whole.sum()) :] ^= EDGE
            doc = made.doc_of[start]
            at, salt = (start - made.starts[doc]) << 32 | made.digests()[doc], np.zeros(len(h), np.int32)
            doc = ids[doc]
            if wanted is not None:
                met, hot = wanted.value
                keep = passed(met, h)
                h, c, doc, at, count = h[keep], c[keep], doc[keep], at[keep], count[keep]
                salt = np.where(passed(hot, h), (mixed(doc.view(U)) % U(SALTS)).astype(np.int32), np.int32(0))
            yield pa.RecordBatch.from_arrays([_i64(h), pa.array(c), pa.array(doc), pa.array(at), pa.array(count.astype(np.int32)), pa.array(salt)], ["h", "c", "doc", "at", "count", "salt"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), text).where("k IS NOT NULL")
    return rows.mapInArrow(run, "h long, c int, doc long, at long, count int, salt int")


def _salted(least: DataFrame, hot) -> DataFrame:
    """A row of a key for each salt that its places may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.where(passed(hot.value[1], batch.column(0).to_numpy(zero_copy_only=False)), SALTS, 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts)], [*batch.schema.names, "parts"])

    out = least.mapInArrow(run, "h long, c int, lo long, src_at long, parts int")
    return out.select("h", "c", "lo", "src_at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, inner: int = 5) -> DataFrame:
    """(doc, th, src_doc, src_at, place): matches; ``place`` has the first word in its high half, the number of windows in the low one."""
    spark: SparkSession = docs.sparkSession
    met = durable(_least_mers(docs, key, text, window, inner).where("lo < hi").select(F.col("m").alias("v"), (F.col("s_lo") == F.col("s_hi")).alias("agreed")))
    bits = spark.sparkContext.broadcast(bitmap(met, "agreed", "NOT agreed"))
    least = _keyed(docs, key, text, window, inner, bits).groupBy("h", "c").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("at", "doc").alias("src_at"), F.count(F.lit(1)).alias("n"))
    least = durable(least.where("lo < hi").select("h", "c", "lo", "src_at", "n"))
    wanted = spark.sparkContext.broadcast(bitmap(least.select(F.col("h").alias("v"), "n"), "true", f"n > {HOT}"))
    rows = _keyed(docs, key, text, window, inner, bits, wanted)
    found = rows.join(_salted(least.drop("n"), wanted), ["h", "c", "salt"]).where("lo < doc")
    place = F.shiftleft(F.shiftright("at", 32), 32).bitwiseOR(F.col("count").cast("bigint"))
    return found.select("doc", F.col("at").bitwiseAND(F.lit(HALF)).alias("th"), F.col("lo").alias("src_doc"), "src_at", place.alias("place"))


SPAN = ("src_doc", "src_th", "shift", "start", "count")


def compacted(src_doc: np.ndarray, src_at: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Matches of one text to the columns of SPAN: each begins where no match goes before on its diagonal, and takes in all successors."""
    start, count = place >> 32, place & HALF
    shift, th = (src_at >> 32) - start, src_at & HALF
    order = np.lexsort((start, shift, th, src_doc))
    src_doc, th, shift, start, end = src_doc[order], th[order], shift[order], start[order], (start + count)[order]
    # Rows that repeat a key and its text repeat their matches: successors may begin at or before an end.
    begins = np.ones(len(start), bool)
    begins[1:] = (src_doc[1:] != src_doc[:-1]) | (th[1:] != th[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(begins)
    end = np.maximum.reduceat(end, at) if len(at) else end
    return [src_doc[at], th[at], shift[at], start[at], end - start[at]]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, inner: int = 5) -> DataFrame:
    """(doc, th, mine): the matches of each text, compacted to the longest runs along both documents."""
    found = matches(docs, key, text, window, inner).groupBy("doc", "th").agg(F.collect_list(F.struct("src_doc", "src_at", "place")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            m = batch.column(2)
            ends, values = m.offsets.to_numpy(), [x.to_numpy() for x in m.values.flatten()]
            spans = [compacted(*(v[a:b] for v in values)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            made = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*spans)], SPAN)
            mine = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(s[0]) for s in spans)]), pa.int32()), made)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mine], ["doc", "th", "mine"])

    return found.mapInArrow(run, f"doc long, th long, mine array<struct<{', '.join(f'{n}: long' for n in SPAN)}>>")


def covered(n: int, starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.minimum(np.asarray(starts, np.int64) + np.asarray(counts, np.int64) + window - 1, n), -1)
    return np.cumsum(change[:n]) > 0


def _text_rows(docs: DataFrame, key: str, text: str, later, asked) -> DataFrame:
    """One pass over the texts: those outside the bitmap ``later`` are finished; texts in ``asked`` are passed on."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, words = batch.column(1), Words(batch.column(2))
            known, ids_ = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            open_, sent = passed(later.value, ids_) & known, passed(asked.value, ids_) & known
            th, texts, digests = [], [], []
            data = memoryview(words.data)
            for k, (a, b) in enumerate(zip(words.borders.tolist(), words.borders.tolist()[1:])):
                one = bytes(data[a:b])
                th.append(xxhash.xxh32_intdigest(one) if sent[k] else 0)
                texts.append(one.decode() if sent[k] else None)
                digests.append(None if open_[k] else hashlib.sha256(b" ".join(one.split())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(th, pa.int64()), pa.array(texts, pa.string()), pa.array(words.sizes.astype(np.int64)), pa.array(digests, pa.string())], [key, "_k", "th", "_text", "n_words", "kept_sha256"])

    return docs.select(key, F.col(key).cast("bigint").alias("_k"), text).mapInArrow(run, f"`{key}` {kind}, _k long, th long, _text string, n_words long, kept_sha256 string")


def _sides(joined: DataFrame, window: int) -> DataFrame:
    """(src_doc, src_th, s, n, d, doc, th, start): digest of the words of each span, of the later side and, with null doc, of the source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for k, th, t, mine, asked in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words = t.encode().split()
                digest = lambda s, n: xxhash.xxh3_64_intdigest(b" ".join(words[s : s + n])) - (1 << 63)  # noqa: E731, B023
                for m in mine or ():
                    n = m["count"] + window - 1
                    rows.append((m["src_doc"], m["src_th"], m["start"] + m["shift"], n, digest(m["start"], n), k, th, m["start"]))
                for m in asked or ():
                    n = m["count"] + window - 1
                    rows.append((k, th, m["s"], n, digest(m["s"], n), None, None, None))
            names = ["src_doc", "src_th", "s", "n", "d", "doc", "th", "start"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 8)], names)

    return joined.select("_k", "th", "_text", "mine", "asked").where("mine IS NOT NULL OR asked IS NOT NULL").mapInArrow(run, "src_doc long, src_th long, s long, n long, d long, doc long, th long, start long")


def _differing(sides: DataFrame) -> DataFrame:
    """(_k, th, bad): first words of the spans whose two sides differ.

    The digests of a source span's copies are combined by their least and greatest
    before the shuffle; only where these differ are spans looked at one by one.
    """
    at = ["src_doc", "src_th", "s", "n"]
    unlike = durable(sides.groupBy(*at).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select(*at))
    own = sides.where("doc IS NULL").join(unlike, at, "left_semi").select(*at, F.col("d").alias("own"))
    return sides.where("doc IS NOT NULL").join(unlike, at, "left_semi").join(own, at).where("d <> own").groupBy(F.col("doc").alias("_k"), "th").agg(F.collect_set("start").alias("bad"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, inner: int = 5) -> DataFrame:
    """Per row: key, n_words, n_removed, and ``kept_sha256`` of the words left, joined by spaces.

    Texts without a repeat, known by a bitmap of the others' keys, are finished where
    they are read; only the others, and the sources of their repeats, are shuffled to
    meet their coordinates.
    """
    context = docs.sparkSession.sparkContext
    mine = durable(repeats(docs, key, text, window, inner))
    spans = mine.select("doc", "th", F.inline("mine"))
    sources = spans.select(F.col("src_doc").alias("_k"), F.col("src_th").alias("th"), (F.col("start") + F.col("shift")).alias("s"), "count").distinct()
    later = context.broadcast(bitmap(spans.select(F.col("doc").alias("v")), "true")[0])
    asked = context.broadcast(bitmap(spans.select(F.col("doc").alias("v")).unionByName(spans.select(F.col("src_doc").alias("v"))), "true")[0])
    asks = mine.withColumnRenamed("doc", "_k").join(sources.groupBy("_k", "th").agg(F.collect_list(F.struct("s", "count")).alias("asked")), ["_k", "th"], "full")
    kind = docs.schema[key].dataType.simpleString()
    rows = durable(_text_rows(docs, key, text, later, asked))
    joined = durable(rows.where("_text IS NOT NULL").select(key, "_k", "th", "_text", F.col("kept_sha256").isNull().alias("_open")).join(asks, ["_k", "th"], "left").where("_open OR asked IS NOT NULL"))
    sides = durable(_sides(joined, window))
    bad = durable(_differing(sides))
    release(sides)
    open_ = joined.where("_open").withColumn("bad", F.lit(None).cast("array<long>")) if bad.isEmpty() else joined.where("_open").join(bad, ["_k", "th"], "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, digests = [], [], []
            for t, mine, bad in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words = t.encode().split() if t else []
                good = [m for m in mine or () if m["start"] not in (bad or ())]
                out = covered(len(words), [m["start"] for m in good], [m["count"] for m in good], window)
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, o in zip(words, out.tolist()) if not o)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    whole = rows.where("kept_sha256 IS NOT NULL").select(key, "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256")
    return whole.unionByName(open_.select(key, "_text", "mine", "bad").mapInArrow(rewrite, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string"))
