"""Line dedup by an exact set-similarity join.

A line's set is its distinct words.  Words are ordered by rarity over all documents:
64-bit word hashes fall into ``SLOTS`` slots by their high bits, slots are ranked by
their counts, and the rank replaces those bits, so that the key's own order is a total
order of words, rare ones first.  Two sets with Jaccard similarity ``t`` or more share
a word among the first ``n - ceil(t n) + 1`` of each; length and position bound the
overlap further, as does a 128-bit parity signature; what is left is verified on the
whole sets.  A prefix word whose slot counts one occurrence in the corpus is in no
other line and is not sent.  A line goes if an earlier line (by document key, then
line number) is that similar to it, whether or not that one stays.

Equal sets are one row, their first line.  A set of so few words that one more or
less takes it below ``t`` (three or fewer at 0.8) can match equal sets only and is not
joined.  A first round holds each line against the earliest and
the previous lines that share a sketch of it, so groups of copies cost a number of
pairs linear in their size; it is dealt by ranges of sketch and document, so no group
needs to fit one task.  A second one holds the lines not yet out against all earlier
ones.  Only kept pairs of keys are shuffled, never pairs of texts.

Null text has no lines.  Lines without a word are never out.  Rows with null key stay
as they are.  Rows that repeat a key and its text are one document; rows that repeat
a key with another text are told apart by a digest of the text (``th``, 0 where the key
is not repeated), and the earlier one of two such lines is that with the lesser line
number.  Keys are whole numbers; a key of another type that does not cast to one is
an error.  An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_name, release, sliced
from .substrings import bitmap, passed
from .tokens import U, Words, line_spans, mixed, pieces, text_bytes

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: Slots counted in one row of the exchange of counts.
PART = 4096
#: Lines (of 16 bytes) that may be broadcast; the count is taken first.
MOST_BROADCAST = 1_000_000
LOW = U((1 << (64 - SLOT_BITS)) - 1)
#: A line's place is its number and, in the low half, the digest of its text.
HALF = (1 << 32) - 1


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")


def rarity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, int]:
    """Rank of each slot of words, rarest first, and the number of slots that count one word or none.

    Tasks send their counts in byte planes, four for each part of the slots, of which
    most compress to nothing; a fixed number of counts reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in sliced(batches):
            total += np.bincount((Words(batch.column(1)).hashes >> U(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        planes = total.view(np.uint8).reshape(-1, PART, 4).transpose(0, 2, 1)
        used = np.flatnonzero(planes.any((1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([planes[k].tobytes() for k in used], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, PART).T).view(np.uint32)[:, 0]
                total[part] = total.get(part, 0) + counts.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    found = _keyed(docs, key, text).mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).toArrow()
    counts = np.zeros((SLOTS // PART, PART), np.int64)
    for part, some in zip(found.column("part").to_pylist(), found.column("counts").to_pylist()):
        counts[part] = np.frombuffer(some, np.int64)
    counts = counts.ravel()
    ranks = np.empty(SLOTS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(SLOTS, dtype=np.uint32)
    return ranks, int((counts <= 1).sum())


def repeated_keys(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """A bitmap of the keys of two rows or more."""
    return bitmap(_keyed(docs, key, text).groupBy(F.col("k").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "true")[0]


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42) & HALF | 1


def in_order(keys: np.ndarray, line: np.ndarray, count: int) -> np.ndarray:
    """The keys of each line in their order; ``line`` ascends, there are ``count`` of them."""
    if count > 1 << 16 or len(keys) > 1 << 28:
        return keys[np.lexsort((keys, line))]
    # Line, rank and place make one number, which sorts many times faster than places do.
    packed = line.astype(U) << U(48) | keys >> U(64 - SLOT_BITS) << U(28) | np.arange(len(keys), dtype=U)
    packed.sort()
    keys = keys[(packed & U((1 << 28) - 1)).view(np.int64)]
    # Words of one slot came by their places: lines where that is not the order are sorted again.
    wrong = np.zeros(count, bool)
    wrong[line[1:][(keys[1:] < keys[:-1]) & (line[1:] == line[:-1])]] = True
    if wrong.any():
        at = np.flatnonzero(wrong[line])
        keys[at] = keys[at][np.lexsort((keys[at], line[at]))]
    return keys


class LineSets:
    """The word sets of lines with a word of a batch of texts; ``wanted`` may pick among (text, line) pairs first: only those are read for words."""

    def __init__(self, texts: pa.Array, ranks: np.ndarray, wanted=None):
        self.data, self.borders = text_bytes(texts)
        if wanted is None:
            found = Words((self.data, self.borders))
            number, doc, h = found.lines(), found.doc, found.hashes
        else:
            doc, number, starts, ends = line_spans(self.data, self.borders)
            pick = np.flatnonzero(wanted(doc, number))
            found = Words(pieces(self.data, starts[pick], ends[pick]))
            number, doc, h = number[pick][found.doc], doc[pick][found.doc], found.hashes
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(new)
        doc, number, sizes = doc[at], number[at], np.diff(at, append=len(h))
        self.doc, self.number = doc, number.astype(np.int64)
        count = len(sizes)
        if not count:
            self.n, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.sid = self.sig = self.sig2 = self.keys = np.zeros(0, U)
            return
        keys = (ranks[(h >> U(64 - SLOT_BITS)).astype(np.int64)].astype(U) << U(64 - SLOT_BITS)) | (h & LOW)
        line = np.repeat(np.arange(count), sizes)
        keys = in_order(keys, line, count)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (line[1:] != line[:-1])
        self.keys, line = keys[new], line[new]
        self.n = np.bincount(line, minlength=count)
        self.starts = np.cumsum(self.n) - self.n
        self.even = even = mixed(self.keys)
        self.sid = mixed(np.add.reduceat(even, self.starts) + self.n.astype(U))
        #: Parity of the words that fall on each of 128 bits: sets differ in as many words as their signatures in bits, or more.
        bit, low = U(1) << (even >> U(58)), even & U(1) == 0
        self.sig = np.bitwise_xor.reduceat(np.where(low, bit, U(0)), self.starts)
        self.sig2 = np.bitwise_xor.reduceat(np.where(low, U(0), bit), self.starts)

    def place(self, repeated: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Line numbers with, where the key is repeated, the digest of the text."""
        th = np.zeros(len(self.borders) - 1, np.int64)
        for k in np.flatnonzero(passed(repeated, ids)).tolist():
            th[k] = digest(self.data[self.borders[k] : self.borders[k + 1]].tobytes())
        return self.number << 32 | th[self.doc]

    def sketch(self, pairs: int = 3) -> np.ndarray:
        """(lines, pairs): hashes of pairs of least-hash words; lines that are much alike share one, others hardly ever."""
        out = np.zeros((len(self.n), pairs), np.int32)
        if len(self.n):
            for k in range(pairs):
                a, b = (np.minimum.reduceat((self.even ^ U(0xA5A5A5A5A5A5A5A5 >> (2 * k + j))) * U(0x9E3779B97F4A7C15 + 2 * (7 * k + j)), self.starts) for j in (0, 1))
                out[:, k] = mixed(a ^ (b << U(1)) + U(k)).astype(np.uint32).view(np.int32)
        return out

    def prefixes(self, sizes: np.ndarray, singles: int) -> pa.Array:
        """Position and low 32 bits of the hash of the first ``sizes`` words of each line that may be in another line."""
        ends = np.concatenate(([0], np.cumsum(sizes)))
        pos = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        words = self.keys[np.repeat(self.starts, sizes) + pos]
        shared = (words >> U(64 - SLOT_BITS)) >= U(singles)
        ends = np.concatenate(([0], np.cumsum(shared)))[ends]
        values = (pos[shared] << 32) | (mixed(words[shared]) & U(HALF)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))

    def lists(self) -> pa.Array:
        """All words of each line."""
        return pa.ListArray.from_arrays(pa.array(np.append(self.starts, len(self.keys)), pa.int32()), pa.array(self.keys.view(np.int64)))


class Corpus:
    """The texts and what is known of all of them, for passes over their lines."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.rows = _keyed(docs, key, text)
        ranks, singles = rarity(docs, key, text)
        self.shared = docs.sparkSession.sparkContext.broadcast((ranks, singles, repeated_keys(docs, key, text)))

    def over(self, rows, schema: str, wanted=None) -> DataFrame:
        """``rows(ids, places, sets, singles)`` as arrays, for every batch of texts."""
        shared, names = self.shared, [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranks, singles, repeated = shared.value
            for batch in sliced(batches):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                sets = LineSets(batch.column(1), ranks, None if wanted is None else (lambda doc, number: wanted(ids[doc], number)))
                yield pa.RecordBatch.from_arrays(rows(ids[sets.doc], sets.place(repeated, ids), sets, singles), names)

        return self.rows.mapInArrow(run, schema)


def all_lines(corpus: Corpus, similarity: float) -> DataFrame:
    """(sid, doc, at, n, sig, sig2, prefix, sketch, lead, more) of every line with a word.

    ``lead``: first of its set in its batch; ``more``: not the only one there.
    """

    def rows(doc, at, sets, singles):
        # A set of n words is like another one only if it could be like one of n + 1 words.
        joined = sets.n >= similarity * (sets.n + 1) - 1e-9
        prefix = np.where(joined, sets.n - np.ceil(similarity * sets.n - 1e-9).astype(np.int64) + 1, 0)
        lead, more = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        if len(doc):
            order = np.lexsort((at, doc, sets.sid))
            first = np.flatnonzero(np.append(True, sets.sid[order][1:] != sets.sid[order][:-1]))
            lead[order[first]] = True
            more[order[first]] = np.diff(first, append=len(order)) > 1
        made = sets.sketch()
        return [
            pa.array(sets.sid.view(np.int64)), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(sets.n, pa.int32()), pa.array(sets.sig.view(np.int64)), pa.array(sets.sig2.view(np.int64)),
            sets.prefixes(prefix, singles), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.int32())), pa.array(lead), pa.array(more),
        ]

    return corpus.over(rows, "sid long, doc long, at long, n int, sig long, sig2 long, prefix array<long>, sketch array<int>, lead boolean, more boolean")


def needed(n_a: Column, n_b: Column, similarity: float) -> Column:
    """Least overlap of two sets that reach the similarity."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (n_a + n_b) - 1e-9)


def may_match(na, nb, pos_a, pos_b, differ, similarity: float, lib) -> tuple:
    """What length, and position and signature, leave possible for two sets, at the first word that they share.

    ``lib`` has ceil, least and greatest, of columns or of arrays.
    """
    ceil, least, greatest = lib
    overlap = ceil(similarity / (1 + similarity) * (na + nb) - 1e-9)
    return least(na, nb) >= ceil(similarity * greatest(na, nb) - 1e-9), (1 + least(na - pos_a - 1, nb - pos_b - 1) >= overlap) & (differ <= na + nb - 2 * overlap)


COLUMNS = F.ceil, F.least, F.greatest
ARRAYS = np.ceil, np.minimum, np.maximum
PLACES = ("doc", "at")


def beside(firsts: DataFrame, similarity: float, earliest: int = 8, previous: int = 32, best: int = 2) -> DataFrame:
    """(doc, at, src_doc, src_at): lines with the likeliest of the earliest and the previous ones that share a sketch.

    Rows are dealt by ranges of (sketch, document) and each task goes through its rows
    once, holding a batch and a few rows, so a group of any size is split over tasks.
    What this round does not hold against each other meets in the second one.
    """
    spread = firsts.where(F.size("prefix") > 0).select(F.explode("sketch").alias("w"), "doc", "at", "n", "sig", "sig2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if not len(new[0]):
                continue
            skip = 0 if held is None else len(held[0])
            w, doc, at, n, sig, sig2 = rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            first = np.maximum.accumulate(np.where(np.append(True, w[1:] != w[:-1]), np.arange(len(w)), 0))
            back, tries = np.arange(skip, len(w)), []
            for step in range(1, previous + 1):
                back = back[back - step >= first[back]]
                tries.append((back - step, back))
            me = np.arange(skip, len(w))
            for step in range(earliest):
                me = me[first[me] + step < me - previous]
                tries.append((first[me] + step, me))
            a, b = (np.concatenate(x) for x in zip(*tries))
            differ = np.bitwise_count(sig[a] ^ sig[b]).astype(np.int64) + np.bitwise_count(sig2[a] ^ sig2[b])
            length, rest = may_match(n[a].astype(np.int64), n[b].astype(np.int64), 0, 0, differ, similarity, ARRAYS)
            ok = length & rest
            a, b, differ = a[ok], b[ok], differ[ok]
            order = np.lexsort((a, differ, b))
            a, b = a[order], b[order]
            nth = np.arange(len(b)) - np.searchsorted(b, b)
            a, b = a[nth < best], b[nth < best]
            start, end = first[-1], len(w)
            keep = np.unique(np.r_[start : min(end, start + earliest), max(start, end - previous) : end])
            held = [x[keep] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(doc[b]), pa.array(at[b]), pa.array(doc[a]), pa.array(at[a])], ["doc", "at", "src_doc", "src_at"])

    dealt = spread.repartitionByRange("w", "doc").sortWithinPartitions("w", "doc", "at")
    return dealt.mapInArrow(run, "doc long, at long, src_doc long, src_at long")


WIDE = 8


def wide_signatures(sets: LineSets) -> list[np.ndarray]:
    """WIDE words of 64 parity bits for each set."""
    if not len(sets.n):
        return [np.zeros(0, np.int64)] * WIDE
    slot = mixed(sets.keys + U(5))
    part, bit = (slot >> U(6)) % U(WIDE), U(1) << (slot & U(63))
    return [np.bitwise_xor.reduceat(np.where(part == U(k), bit, U(0)), sets.starts).view(np.int64) for k in range(WIDE)]


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (doc, at, src_doc, src_at) that are similar enough, by the whole sets."""
    words = sets.select("doc", "at", "words")
    a, b = words.alias("a"), words.alias("b")
    both = pairs.alias("p").join(b, (F.col("p.doc") == F.col("b.doc")) & (F.col("p.at") == F.col("b.at"))).join(a, (F.col("p.src_doc") == F.col("a.doc")) & (F.col("p.src_at") == F.col("a.at")))
    hit = F.size(F.array_intersect("a.words", "b.words")) >= needed(F.size("a.words"), F.size("b.words"), similarity)
    return both.where(hit).groupBy("p.doc", "p.at").agg(F.min(F.struct("src_doc", "src_at")).alias("s")).select("doc", "at", "s.*")


def verified(corpus: Corpus, pairs: DataFrame, similarity: float) -> DataFrame:
    """(doc, at, src_doc, src_at): every later line of the pairs with a similar earlier one.

    Pairs pass a wider signature before any set is moved.  One pair decides, so each
    line's likeliest is verified first; only lines that it leaves open have all their
    pairs verified.
    """
    pairs = durable(pairs.distinct())
    sides = pairs.select("doc", "at").unionByName(pairs.select(F.col("src_doc").alias("doc"), F.col("src_at").alias("at")))
    bits = pairs.sparkSession.sparkContext.broadcast(bitmap(sides.select(F.col("doc").bitwiseXOR(F.shiftleft(F.shiftright("at", 32), 16)).alias("v")), "true")[0])
    marks = [f"s{k}" for k in range(WIDE)]

    def rows(doc, at, sets, _):
        return [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(sets.n, pa.int32()), *map(pa.array, wide_signatures(sets)), sets.lists()]

    def wanted(doc, number):
        return passed(bits.value, doc ^ (number << 16))

    schema = ", ".join(["doc long", "at long", "n int", *(f"{m} long" for m in marks), "words array<long>"])
    sets = durable(corpus.over(rows, schema, wanted))
    narrow = sets.drop("words")
    differ = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in marks), F.lit(0))
    room = F.col("a.n") + F.col("b.n") - 2 * needed(F.col("a.n"), F.col("b.n"), similarity)
    p, a, b = pairs.alias("p"), narrow.alias("a"), narrow.alias("b")
    near = p.join(b, (F.col("p.doc") == F.col("b.doc")) & (F.col("p.at") == F.col("b.at"))).join(a, (F.col("p.src_doc") == F.col("a.doc")) & (F.col("p.src_at") == F.col("a.at")))
    near = durable(near.where(differ <= room).select("p.doc", "p.at", "src_doc", "src_at", differ.alias("differ")))
    likeliest = near.groupBy("doc", "at").agg(F.min(F.struct("differ", "src_doc", "src_at")).alias("s")).select("doc", "at", "s.src_doc", "s.src_at")
    found = durable(similar(likeliest, sets, similarity))
    rest = durable(near.drop("differ").join(found.select("doc", "at"), ["doc", "at"], "left_anti").join(likeliest, ["doc", "at", "src_doc", "src_at"], "left_anti"))
    out = found if rest.isEmpty() else durable(found.unionByName(similar(rest, sets, similarity)))
    for frame in (pairs, sets, near, rest):
        release(frame)
    return out


def out_places(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc, at, src_doc, src_at): every line that goes, and an earlier line that it is similar to."""
    corpus = Corpus(docs, key, text)
    wide = durable(all_lines(corpus, similarity))
    by_set = Window.partitionBy("sid").orderBy("doc", "at")
    firsts = wide.where("lead").withColumn("_r", F.row_number().over(by_set)).withColumn("_next", F.lead("doc").over(by_set)).where("_r = 1")
    firsts = durable(firsts.select("sid", "doc", "at", "n", "sig", "sig2", "prefix", "sketch", (F.col("more") | F.col("_next").isNotNull()).alias("copied")))
    lines = durable(wide.select("sid", "doc", "at"))
    release(wide)
    # First round: the earliest and the previous lines with a sketch in common.
    out = verified(corpus, beside(firsts, similarity), similarity)
    # Second round: lines not yet out against all earlier ones; both sides are one plan, so its exchange is used twice.
    gone = out.select("doc", "at", F.lit(1).alias("_gone"))
    if out.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    # ``m``: words of the line, position of this one, and whether the line is out.
    words = firsts.where(F.size("prefix") > 0).join(gone, ["doc", "at"], "left").select(F.explode("prefix").alias("x"), "doc", "at", "n", "sig", "sig2", F.coalesce("_gone", F.lit(0)).alias("gone"))
    m = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.shiftright("x", 32), 1)).bitwiseOR(F.col("gone").cast("bigint"))
    words = words.select(F.col("x").bitwiseAND(F.lit(HALF)).alias("w"), "doc", "at", m.alias("m"), "sig", "sig2")
    size = lambda s: F.shiftright(f"{s}.m", 32)
    pos = lambda s: F.shiftright(F.col(f"{s}.m").bitwiseAND(F.lit(HALF)), 1)
    differ = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) + F.bit_count(F.col("a.sig2").bitwiseXOR(F.col("b.sig2")))
    # Said with columns of both sides, lest it be pushed below one side's exchange: no line that is out is a ``b``.
    open_ = F.col("b.m").bitwiseAND(F.lit(1)) <= F.col("a.m").bitwiseAND(F.lit(0))
    earlier = (F.col("a.doc") < F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.at") < F.col("b.at")))
    length, room = may_match(size("a"), size("b"), pos("a"), pos("b"), differ, similarity, COLUMNS)
    rest = words.alias("a").join(words.alias("b"), (F.col("a.w") == F.col("b.w")) & earlier & open_ & length & room)
    rest = rest.select(F.col("b.doc").alias("doc"), F.col("b.at").alias("at"), F.col("a.doc").alias("src_doc"), F.col("a.at").alias("src_at"))
    out = out.unionByName(verified(corpus, rest, similarity))
    # Every line of a set goes but its first, and that too if an earlier line is similar.
    judged = firsts.select("sid", F.col("doc").alias("f_doc"), F.col("at").alias("f_at"), "copied").join(out.select(F.col("doc").alias("f_doc"), F.col("at").alias("f_at"), "src_doc", "src_at"), ["f_doc", "f_at"], "left")
    judged = durable(judged.where("copied OR src_doc IS NOT NULL"))
    release(firsts)
    met = lines.join(judged, "sid")
    later = (F.col("f_doc") < F.col("doc")) | ((F.col("f_doc") == F.col("doc")) & (F.col("f_at") < F.col("at")))
    source = lambda c: F.when(F.col("src_doc").isNotNull(), F.col(f"src_{c}")).otherwise(F.col(f"f_{c}")).alias(f"src_{c}")
    return met.where(F.col("src_doc").isNotNull() | later).select("doc", "at", source("doc"), source("at"))


def out_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc, line, th, src_doc, src_line, src_th): ``out_places`` with line numbers and text digests apart; th is 0 where no other row has the key."""
    line = lambda c: F.shiftright(c, 32).cast("int")
    th = lambda c: F.col(c).bitwiseAND(F.lit(HALF))
    return out_places(docs, key, text, similarity).select("doc", line("at").alias("line"), th("at").alias("th"), "src_doc", line("src_at").alias("src_line"), th("src_at").alias("src_th"))


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the lines that go; all rows stay, if with empty text."""
    k, gone = free_name(docs.columns, "_k"), free_name(docs.columns, "_gone")
    marks = out_places(docs.select(key, text), key, text, similarity).groupBy(F.col("doc").alias(k)).agg(F.collect_set("at").alias(gone))
    met = docs.withColumn(k, F.col(key).cast("bigint")).join(marks, k, "left").select(*(F.col(f"`{c}`") for c in docs.columns), gone)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            for t, g in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if t and g:
                    th = digest(t.encode()) if any(x & HALF for x in g) else 0
                    g = {x >> 32 for x in g if x & HALF == th}
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]], batch.schema.names[:-1])

    return met.mapInArrow(run, docs.schema)
