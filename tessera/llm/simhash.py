"""SimHash near-duplicates by a range join over per-segment bit counts.

A fingerprint becomes the vector of its segments' bit counts.  The Manhattan distance
of two vectors never exceeds the Hamming distance of their fingerprints.  Counts are
kept in unary (the set bits of each segment moved to its low end), which makes that
distance the Hamming distance of the unary words.  The axes form ``bands``; within
distance ``d`` at most ``d`` bands differ, so two near vectors share a cell of the
grid over some ``bands - d`` of the bands: the range join becomes equality joins, one for
each choice of bands.  Their number grows with the logarithm of the number of
fingerprints, so that cells stay small.  Fingerprints that share a cell are held
against each other in blocks: first by Manhattan distance, then exactly.

Equal fingerprints are one row until the end.  Cells with more than ``block``
fingerprints are cut into parts, and pairs of parts go to different tasks, so no
group gathers in one task.  A block passes on one edge for each fingerprint that it
links to a smaller one, not all its pairs, which leaves the components unchanged.

Null text has no words; its fingerprint is zero, linked like any other.  Null keys
count as larger than all others.  Repeated rows and ties share their component.  An
empty table gives an empty result.  Only the key and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, sliced
from .graph import components


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of ``width`` words, A-Z in lower case."""
    words = text.encode().lower().split() if text else []  # bytes: only ASCII changes case or separates
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    hashes = np.array([hash64(joined[s:e], 42) for s, e in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): fingerprints as signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary(fp, segment: int = 2):
    """The embedding as a Column: for segments of two bits, both set, either set."""
    if segment != 2:
        raise ValueError("the unary form is written for segments of two bits")
    low = F.lit(0x5555555555555555)
    over = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(over).bitwiseAND(low), fp.bitwiseAND(over).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def unary_words(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    over = fp >> np.uint64(1)
    return ((fp | over) & low) | ((fp & over & low) << np.uint64(1))


def bands_for(n: int, distance: int = 3, least: int = 6, most: int = 16) -> int:
    """The fewest bands whose cells tell ``n`` fingerprints apart: 32 axes of three counts have 48 bits, of which a cell keeps its bands' share."""
    return next((b for b in range(max(least, distance + 1), most) if 48 * (b - distance) / b >= math.log2(max(2, n))), most)


def cells(fps: DataFrame, distance: int, bands: int) -> DataFrame:
    """(cell, fp): each fingerprint in its cell of every grid over ``bands - distance`` bands."""
    edges = [round(32 * k / bands) * 2 for k in range(bands + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(bands), bands - distance)]
    grid = F.array(*(F.xxhash64(F.lit(k), unary(F.col("fp")).bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)))
    return fps.select(F.explode(grid).alias("cell"), "fp")


def linked(block: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by block: (fingerprint, smaller one it is linked with through its block), one for each linked row."""
    same = block[1:] == block[:-1]
    held = np.zeros(len(block), bool)
    held[1:] |= same
    held[:-1] |= same
    block, fp = block[held], fp[held]
    if not len(fp):
        return fp, fp
    nodes, at = np.unique(fp, return_inverse=True)
    word = unary_words(fp)
    root = np.arange(len(nodes))
    left, step = np.arange(len(fp)), 1
    while True:
        left = left[left + step < len(fp)]
        left = left[block[left] == block[left + step]]
        if not len(left):
            break
        right = left + step
        near = np.bitwise_count(word[left] ^ word[right]) <= distance
        a, b = left[near], right[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = at[a[near]], at[b[near]]
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
        step += 1
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def links(fps: DataFrame, distance: int = 3, bands: int = 6, block: int = 2048) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``fps`` within ``distance``."""
    rows = cells(fps, distance, bands)
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts").cast("int") - 1), lambda k: F.xxhash64("cell", F.least(k.cast("bigint"), part), F.greatest(k.cast("bigint"), part)))
    dealt = rows.join(parts, "cell", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("cell")).otherwise(others)).alias("block"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_block, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            kept_block = np.concatenate([kept_block, batch.column(0).to_numpy(zero_copy_only=False)])
            kept_fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(kept_block) < 20_000:
                continue
            whole = int(np.searchsorted(kept_block, kept_block[-1]))  # the last block may go on
            if whole:
                yield edges_of(kept_block[:whole], kept_fp[:whole])
                kept_block, kept_fp = kept_block[whole:], kept_fp[whole:]
        yield edges_of(kept_block, kept_fp)

    def edges_of(blocks: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = linked(blocks, fp, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3, bands: int | None = None) -> DataFrame:
    """Per row: key, ``fingerprint`` (hex) and ``component_id``, the least key reachable over links of ``distance`` bits."""
    rows = durable(fingerprints(docs, key, text, width))
    distinct = durable(rows.groupBy("fp").agg(F.min(key).alias("_first")))
    found = components(links(distinct.select("fp"), distance, bands or bands_for(distinct.count(), distance)))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    least = distinct.join(members.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("_first").alias("_least"))
    named = members.join(least, "root").select(F.col("node").alias("fp"), "_least")
    ids = durable(distinct.join(named, "fp", "left").select("fp", F.coalesce("_least", "_first").alias("component_id")))
    return rows.join(ids, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows whose key is the least of its group; other columns stay as they are.

    Rows without a key stay.  Rows that repeat a key stay together.
    """
    judged = groups(docs.select(key, text), key, text, **how)
    out = judged.where(F.col("component_id") < F.col(key)).select(key).distinct()
    return docs.join(out, key, "left_anti")
