"""Benchmark decontamination by templates.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised, but not
all capitals, inside a sentence) and units become typed placeholders.  Windows of five
template words of the documents meet those of the benchmark in a hash join.  A window
with names also has a plain form, in which names stay words, so that copies in other case
are met: a window of an item is hit if either form is.  A document
that holds 80 % or more of an item's windows contains the item, whether word for word
or with other values, if its slots are consistent: along the best alignment, each value
of the item is always replaced by the same value.  Where 80 % of the windows are met
with their own values, slots are not asked.

An item with fewer than five words is one window of all its words, met word for word
(case and punctuation aside); a text without words, null among them, is in no document.
Rows with null key are not judged; keys of documents and items are whole numbers, and one
that does not cast to one is an error; rows with one key are one document; repeated items
are found alike.  Texts of any length are read whole.  Empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sliced
from .substrings import bitmap, passed
from .tokens import U, mixed

UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ton tons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years ml l liter liters litre litres gallon gallons mph kph c f k percent dollar dollars usd eur euro euros cent cents".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|[a-zA-Z]{1,3})?")
EDGES = ".,;:!?()[]{}<>\"'`*#&|%$«»“”‘’…-"
ENDS = tuple(".!?:;\"”»")

#: Flags in the low three bits of a word's value; the rest is the template hash, or a placeholder's type.
SKIP, CAPITAL, END = 1, 2, 4
NUM, UNIT, NAME = 8, 16, 24
TEMPLATE = U((1 << 64) - 8)


class Vocabulary(dict):
    """Word to template hash and flags; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = word.strip(EDGES)
        flags = END if word == "\0" or word.endswith(ENDS) else 0
        if word == "\0" or not core:
            found = flags | SKIP
        elif not core.isalpha() and NUMBER.fullmatch(core) or (low := core.casefold()) in NUMBERS:
            found = flags | NUM
        elif low in UNITS:
            found = flags | UNIT
        else:
            found = (xxhash.xxh64_intdigest(low, 11) | 1 << 63) >> 3 << 3 | flags | (CAPITAL if core[0].isupper() and not core.isupper() else 0)
        self[word] = found
        return found


class Exact(dict):
    """Word to the hash of its bare form, numbers and units included; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.strip(EDGES).casefold(), 13)
        return found


class Templates:
    """Template words of a batch of texts, and their windows."""

    def __init__(self, texts: list[str | None], width: int, vocabulary: Vocabulary):
        # A line's end is a sentence's end.
        split = [t.replace("\n", " \0 ").split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        raw = [w for ws in split for w in ws]
        values = np.fromiter(map(vocabulary.__getitem__, raw), U, len(raw))
        flags, hashes = values.astype(np.uint8) & 7, values & TEMPLATE
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = np.zeros(len(raw), bool)
        if len(raw):
            inside[1:] = (flags[:-1] & END == 0) & (doc[1:] == doc[:-1])
        keep = np.flatnonzero(flags & SKIP == 0)
        self.plain_words = hashes[keep]
        hashes[(flags & CAPITAL > 0) & inside] = NAME
        self.raw, self.at, self.words, self.doc = raw, keep, hashes[keep], doc[keep]
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.start = self.starts(width)
        #: Hashes of the template and of the plain form; equal in windows without a name.
        self.window, self.plain = self._rolled(self.words, width, self.start), self._rolled(self.plain_words, width, self.start)

    def starts(self, width: int) -> np.ndarray:
        """First words of all windows of a width."""
        return np.flatnonzero(self.doc[width - 1 :] == self.doc[: len(self.doc) - width + 1]) if len(self.doc) >= width else np.zeros(0, np.int64)

    def exact(self, width: int, vocabulary: Exact, start: np.ndarray) -> np.ndarray:
        """Hashes of windows of the words as they are."""
        words = np.fromiter((vocabulary[self.raw[k]] for k in self.at.tolist()), U, len(self.at))
        return mixed(self._rolled(words, width, start) + U(width))

    @staticmethod
    def _rolled(words: np.ndarray, width: int, start: np.ndarray) -> np.ndarray:
        even, count = mixed(words), max(0, len(words) - width + 1)
        total = np.zeros(count, U)
        for k in range(width):
            total = total * U(0x9E3779B97F4A7C15) + even[k : count + k]
        return mixed(total[start])

    def slots(self, start: int, width: int, plain: bool = False) -> list[str]:
        """The values at the placeholders of a window."""
        words = self.plain_words if plain else self.words
        return [self.raw[self.at[k]].strip(EDGES).casefold() for k in range(start, start + width) if words[k] <= NAME]


def _windows(rows: DataFrame, width: int, bits=None, short: tuple[int, ...] | None = None) -> DataFrame:
    """(h, window, id, pos, slots, width) of both forms of all windows, or of those in the bitmap; ``window`` is the template's hash.

    Windows of fewer words are exact: those of the widths ``short``, or, where that is
    None, the one of each shorter text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, exact = Vocabulary(), Exact()
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            made = Templates(batch.column(1).to_pylist(), width, vocabulary)
            named = np.flatnonzero(made.plain != made.window)
            # (first word, template, hash, kind: 0 template, 1 plain form, 2 exact; width) of each window
            parts = [(made.start, made.window, made.window, 0, width), (made.start[named], made.window[named], made.plain[named], 1, width)]
            for w in range(1, width) if short is None else short:
                start = made.starts(w) if short is not None else made.first[made.sizes == w]
                if len(start):
                    h = made.exact(w, exact, start)
                    parts.append((start, h, h, 2, w))
            start, window, h = (np.concatenate([p[k] for p in parts]) for k in range(3))
            form, wide = (np.concatenate([np.full(len(p[0]), p[k]) for p in parts]) for k in (3, 4))
            if bits is not None and len(h):
                keep = passed(bits.value, h)
                start, window, h, form, wide = (x[keep] for x in (start, window, h, form, wide))
            doc = made.doc[start] if len(start) else np.zeros(0, np.int64)
            pos = start - made.first[doc] if len(start) else start
            slots = [[] if k == 2 else made.slots(s, width, k == 1) for s, k in zip(start.tolist(), form.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(window.view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(pos.astype(np.int32)), pa.array(slots, pa.list_(pa.string())), pa.array(wide.astype(np.int32))],
                ["h", "window", "id", "pos", "slots", "width"],
            )

    return rows.mapInArrow(run, "h long, window long, id long, pos int, slots array<string>, width int")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, item, n_windows, n_hit, n_slots): the documents that contain an item.

    A bitmap of fixed size keeps documents' windows that no item has from the shuffle;
    the join decides.  Each window of a document counts once before it meets the items;
    positions and slots meet only for the pairs that hold enough windows.
    """
    items = durable(_windows(benchmark.select(F.col(item).cast("bigint").alias("k"), item_text).where("k IS NOT NULL"), width))
    sizes = items.groupBy("id").agg(F.countDistinct("window").alias("n_windows"))
    short = tuple(sorted(r[0] for r in items.select("width").distinct().where(F.col("width") < width).collect()))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(items.select(F.col("h").alias("v")).distinct(), "true")[0])
    # Few windows pass: they are kept, so that texts are read once.
    found = durable(_windows(docs.select(F.col(key).cast("bigint").alias("k"), text).where("k IS NOT NULL"), width, bits, short).select("h", F.col("id").alias("doc"), "pos", "slots"))
    items = items.select("h", "window", F.col("id").alias("item"), F.col("pos").alias("i_pos"), F.col("slots").alias("i_slots"))
    enough = F.ceil(F.lit(similarity) * F.col("n_windows") - 1e-9)
    hits = found.select("h", "doc").distinct().join(items.select("h", "window", "item").distinct(), "h").select("doc", "item", "window").distinct()
    hits = hits.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_hit"))
    hits = durable(hits.join(sizes.withColumnRenamed("id", "item"), "item").where(F.col("n_hit") >= enough))
    # Windows met with the item's own values, by distinct values on both sides.
    same = found.select("h", "doc", "slots").distinct().join(hits.select("doc", "item"), "doc").join(items.select("h", "window", "item", F.col("i_slots").alias("slots")).distinct(), ["h", "item", "slots"])
    same = same.select("doc", "item", "window").distinct().groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_same"))
    # Slots: the best alignment, and whether each item value has one replacement.
    slotted = found.join(hits.select("doc", "item"), "doc").join(items.where(F.size("i_slots") > 0), ["h", "item"]).withColumn("shift", F.col("pos") - F.col("i_pos"))
    best = slotted.groupBy("doc", "item", "shift").agg(F.count(F.lit(1)).alias("n")).groupBy("doc", "item").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    values = slotted.join(best, ["doc", "item", "shift"]).select("doc", "item", F.explode(F.arrays_zip("i_slots", "slots")).alias("v"))
    pairs = values.select("doc", "item", F.col("v.i_slots").alias("was"), F.col("v.slots").alias("is")).groupBy("doc", "item", "was").agg(F.min("is").alias("lo"), F.max("is").alias("hi"))
    slots = pairs.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_slots"), F.bool_and(F.col("lo") == F.col("hi")).alias("agree"))
    out = hits.join(slots, ["doc", "item"], "left").join(same, ["doc", "item"], "left").where(F.coalesce("agree", F.lit(True)) | (F.coalesce("n_same", F.lit(0)) >= enough))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item), "n_windows", "n_hit", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that contain no item, as they are.

    The keys found are written first: Spark then knows their size and, while they are
    few, does not shuffle the texts.
    """
    out = durable(contaminated(docs.select(key, text), benchmark, key, text, **how).select(F.col(key)).distinct())
    return docs.join(out, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
