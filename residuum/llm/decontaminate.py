"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens: some positions count, the others are
ignored, so a seed still hits when an ignored token was substituted. No overlap (see
below) escapes ``MASKS``: halving an overlap leaves a half that is one, down to 25
tokens, so each holds 13 tokens with 3 unequal ones at most, or 16 with 4, 20 with 5 or
24 with 6, and each such pattern has a place where a mask fits (tested for all of them).
The seed hashes of all positions of all benchmark items are joined with those of
all positions of all documents. Around each hit the two texts are aligned without
gaps and compared token by token; a stretch of the alignment is an overlap if it has
at least ``MIN_TOKENS`` tokens, of which a share of ``IDENTITY`` is equal. Of an
alignment the longest such stretch is reported, less unequal tokens at its ends as far
as ``MIN_TOKENS`` remain.

Tokens are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text; each character of a script without spaces between words (``UNSPACED``)
is a token of its own. Nothing of a document is sent through a shuffle: the benchmark's
seeds are the broadcast side of the join, as long as its tokens are ``BLOCK_TOKENS`` at
most. A larger benchmark is dealt by hash to blocks of about that size, which Spark
writes into the shared folder; the tasks read block after block for each ``CHUNK_BYTES``
of documents. So documents are read once, a task holds one block at a time, and neither
the driver nor a broadcast grows with the benchmark.

An item of fewer tokens than ``MIN_TOKENS`` overlaps where all of its tokens stand in
the document one after another, if it has ``SHORT_TOKENS`` at least; still shorter ones
say too little and overlap with nothing.

Repetitive texts: equal seeds are reduced to alignments with arrays, ``PAIRS`` at a
time, and a text and an item with more equal seeds than alignments have all their
alignments tried, so work is bounded by the product of their lengths.

Null or blank texts and items have no tokens and no overlaps. Repeated items (same id and text) count once;
repeated documents are each reported. Of several overlaps of a document row and an
item the one with the most equal tokens is reported, on ties the first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import as_binary, give_back, slices
from residuum.llm.wordhash import NOT_ALNUM, Grams, mix, row_bounds, words
from residuum.session import scratch_path
from residuum.sources.ranges import file_system

MASKS = ("110111", "1101000011", "1100000100011")  # only for these MIN_TOKENS and IDENTITY
MIN_TOKENS = 13
IDENTITY = 0.75
PENALTY = int(IDENTITY / (1 - IDENTITY))  # equal tokens that make up for an unequal one
BLOCK_TOKENS = 500_000
CHUNK_BYTES = 64 << 20  # of documents that a task holds while it reads the blocks
FILTER_BITS = 22
SHORT_TOKENS = 5
PAIRS = 1 << 20   # equal seeds looked at in one go

# Tibetan, Thai, Lao; Burmese; Khmer; Tai and others of the south-east; radicals; kana and
# bopomofo; ideographs; Yi; Javanese; Burmese and Tai Viet; ideographs; half-width kana.
# Ideographs beyond U+FFFF are tokens, too.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x2E80, 0x2FDF),
            (0x3040, 0x312F), (0x31A0, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xAADF),
            (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
_UNSPACED = np.zeros(1 << 16, bool)
for _first, _last in UNSPACED:
    _UNSPACED[_first:_last + 1] = True

_OFFSETS = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]


def tokens(data: np.ndarray, off: np.ndarray):
    return words(data, off, NOT_ALNUM, unspaced(data))


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces start and end in UTF-8 bytes."""
    three = np.flatnonzero((data & 0xF0) == 0xE0)  # lead bytes of U+0800 to U+FFFF
    a, b, c = (data[three + i].astype(np.int32) for i in range(3))
    three = three[_UNSPACED[(a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F]]
    four = np.flatnonzero(data >= 0xF0)
    a, b = (data[four + i].astype(np.int32) for i in range(2))
    four = four[np.isin((a & 0x07) << 2 | (b & 0x3F) >> 4, (2, 3))]  # planes of ideographs
    return np.concatenate([three, three + 3, four, four + 4])


def fits(row: np.ndarray, mask: int) -> np.ndarray:
    """Whether the mask's span lies in one text, at each token where it fits into the slice."""
    span = len(MASKS[mask])
    return row[:max(0, len(row) - span + 1)] == row[span - 1:]


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Seed hash at each token where the mask's span fits into the slice."""
    n = len(h) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, mask + 1, np.uint64)
    for k in _OFFSETS[mask]:
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(s)


class Seeds:
    """Seed table of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = as_binary(pa.array([t for _, t in items], pa.string()))
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first, data, off in slices(texts):
            row, h = tokens(data, off)
            rows.append(row + first)
            hashes.append(h)
        self.row, self.h = np.concatenate(rows), np.concatenate(hashes)
        self.bounds = row_bounds(self.row, len(items))
        # places of each seed in order of seed and item, and the runs of one seed and item
        self.at, self.run, self.key, self.item, self.filter = [], [], [], [], []
        for m in range(len(MASKS)):
            at = np.flatnonzero(fits(self.row, m))
            s = seeds(self.h, m)[at]
            order = np.lexsort((at, s))
            at, s = at[order], s[order]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(s) != 0) | (np.diff(self.row[at]) != 0)
            run = np.flatnonzero(new)
            self.at.append(at)
            self.run.append(np.append(run, len(at)))
            self.key.append(s[run])
            self.item.append(self.row[at[run]])
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[s >> np.uint64(64 - FILTER_BITS)] = True
            self.filter.append(bits)
        count, grams = np.diff(self.bounds), Grams(self.h)
        self.short = {}  # length: hashes of whole items, and the items
        for n in range(SHORT_TOKENS, MIN_TOKENS):
            which = np.flatnonzero(count == n)
            if len(which):
                whole = grams.of(self.bounds[which], self.bounds[which] + n)
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], which[order]

    def equal_seeds(self, row: np.ndarray, h: np.ndarray, m: int):
        """``(place in the text, run)`` of every seed of the mask that an item has, in parts."""
        s = seeds(h, m)
        pos = np.flatnonzero(self.filter[m][s >> np.uint64(64 - FILTER_BITS)] & fits(row, m))
        lo = np.searchsorted(self.key[m], s[pos], side="left")
        n = np.searchsorted(self.key[m], s[pos], side="right") - lo
        for part in parts(n):
            yield np.repeat(pos[part], n[part]), spread(lo[part], n[part])

    def hits(self, row: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """``(text, item, document token - item token)`` of alignments: all with an equal
        seed, and all of a text and an item that have more equal seeds than alignments."""
        items = len(self.ids)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(len(MASKS)):
            for pos, run in self.equal_seeds(row, h, m):
                pair, at = np.unique(row[pos] * items + self.item[m][run], return_inverse=True)
                keys.append(pair)
                counts.append(np.bincount(at, weights=np.diff(self.run[m])[run], minlength=len(pair)).astype(np.int64))
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(at, weights=np.concatenate(counts), minlength=len(pair))
        text, item = pair // items, pair % items
        size, own = np.diff(bounds)[text], np.diff(self.bounds)[item]
        dense = seen > size + own
        found = [np.zeros(0, np.int64)]
        for m in range(len(MASKS)):
            for pos, run in self.equal_seeds(row, h, m):
                k = np.searchsorted(pair, row[pos] * items + self.item[m][run])
                pos, run, k = (x[~dense[k]] for x in (pos, run, k))
                n = np.diff(self.run[m])[run]
                for part in parts(n):
                    shift = np.repeat(pos[part], n[part]) - self.at[m][spread(self.run[m][run[part]], n[part])]
                    found.append(np.unique((np.repeat(k[part], n[part]) << 34) + shift + (1 << 33)))
        sparse = np.unique(np.concatenate(found))
        out = list(zip(text[sparse >> 34].tolist(), item[sparse >> 34].tolist(), ((sparse & ((1 << 34) - 1)) - (1 << 33)).tolist()))
        for t, i in zip(text[dense].tolist(), item[dense].tolist()):
            first = int(bounds[t] - self.bounds[i + 1]) + MIN_TOKENS
            out += [(t, i, shift) for shift in range(first, int(bounds[t + 1] - self.bounds[i]) - MIN_TOKENS + 1)]
        return out

    def whole_items(self, row: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple]:
        """Short items that a text holds whole, each at its first place."""
        out, grams = {}, Grams(h)
        for n, (whole, which) in self.short.items():
            at = np.flatnonzero(row[:max(0, len(row) - n + 1)] == row[n - 1:])
            s = grams.of(at, at + n)
            lo, hi = np.searchsorted(whole, s, side="left"), np.searchsorted(whole, s, side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for i in which[a:b].tolist():
                    out.setdefault((int(row[p]), i), (-n, int(p - bounds[row[p]]), 0, n))
        return out

    def overlaps(self, data: np.ndarray, off: np.ndarray) -> list[tuple]:
        """``(text, item id, document token, item token, tokens, equal)`` of a slice."""
        row, h = tokens(data, off)
        bounds = row_bounds(row, len(off) - 1)
        best: dict[tuple[int, int], tuple] = self.whole_items(row, h, bounds)
        for r, i, shift in self.hits(row, h, bounds):
            lo = max(self.bounds[i], bounds[r] - shift)
            hi = min(self.bounds[i + 1], bounds[r + 1] - shift)
            equal = self.h[lo:hi] == h[lo + shift:hi + shift]
            if np.count_nonzero(equal) < MIN_TOKENS * IDENTITY:
                continue
            a, z = best_stretch(equal)
            if z - a >= MIN_TOKENS:
                inside = a + np.flatnonzero(equal[a:z])
                same = len(inside)
                z = max(int(inside[-1]) + 1, a + MIN_TOKENS)
                a = min(int(inside[0]), z - MIN_TOKENS)
                got = (-same, int(lo + a + shift - bounds[r]), int(lo + a - self.bounds[i]), int(z - a))
                if (r, i) not in best or got < best[r, i]:
                    best[r, i] = got
        return [(r, self.ids[i], d, q, n, -same) for (r, i), (same, d, q, n) in sorted(best.items())]


def parts(n: np.ndarray) -> list[np.ndarray]:
    """Positions of ``n`` in runs whose sum is about ``PAIRS``."""
    there = np.flatnonzero(n)
    cut = np.flatnonzero(np.diff(np.cumsum(n[there]) // PAIRS)) + 1
    return np.split(there, cut) if len(there) else []


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lo, lo + 1, ...``, ``n`` numbers each."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch of which a share of ``IDENTITY`` is equal; the first such."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    # the greatest total from each place on, last place first: the farthest end for each start
    rest = np.maximum.accumulate(total[::-1])
    end = len(equal) - np.searchsorted(rest, total, side="left")
    start = int(np.argmax(end - np.arange(len(total))))
    return (start, int(end[start])) if end[start] > start else (0, 0)


def stored_blocks(root: str) -> Iterator[Seeds]:
    """Seed tables of the blocks of items under ``root``, one at a time."""
    fs, folder = file_system(root)
    for f in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path):
        if f.base_name.startswith("block="):
            items = pads.dataset(f.path, filesystem=fs, format="parquet").to_table(columns=["id", "text"])
            yield Seeds(list(zip(*(c.to_pylist() for c in items.columns))))


def seed_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"
                ) -> tuple[Callable[[], Iterable[Seeds]], int]:
    """What gives a task the seed tables of all items, each of a bounded size, and the
    bytes of documents worth reading them for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("text")) \
        .filter(F.col("text").isNotNull()).distinct()
    # a token has at least one byte and a gap, so bytes / 2 bounds the tokens
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 2 / BLOCK_TOKENS))
    if blocks == 1:
        rows = items.orderBy("id", "text").collect()
        shared = spark.sparkContext.broadcast(Seeds([(r["id"], r["text"]) for r in rows]))
        return lambda: [shared.value], 0
    root = scratch_path(spark, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition("block") \
        .write.partitionBy("block").parquet(root)
    return lambda: stored_blocks(root), CHUNK_BYTES


def chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of about ``limit`` bytes, of one batch at least."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item_id, doc_token, item_token, n_tokens, n_equal)``, a row for each
    row of ``docs`` and item that overlap."""
    tables, limit = seed_blocks(benchmark)

    def run(batches):
        for held in chunks(batches, limit):
            for seeds in tables():
                for b in held:
                    for first, data, off in slices(as_binary(b.column(1))):
                        found = seeds.overlaps(data, off)
                        cols = list(zip(*found)) if found else [()] * 6
                        yield pa.record_batch(
                            [b.column(0).take(pa.array([first + r for r in cols[0]], pa.int64())),
                             pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]],
                            ["id", "item_id", "doc_token", "item_token", "n_tokens", "n_equal"])
            give_back()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(text_col).alias("text")) \
        .mapInArrow(run, "id bigint, item_id bigint, doc_token int, item_token int, n_tokens int, n_equal int") \
        .withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, with all columns."""
    judged = "_judged"
    while judged in docs.columns:
        judged += "_"
    tables, limit = seed_blocks(benchmark)

    def run(batches):
        for held in chunks(batches, limit):
            keep = [np.ones(b.num_rows, bool) for b in held]
            for seeds in tables():
                for b, stay in zip(held, keep):
                    for first, data, off in slices(as_binary(b.column(b.num_columns - 1))):
                        for r, *_ in seeds.overlaps(data, off):
                            stay[first + r] = False
            give_back()
            for b, stay in zip(held, keep):
                yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(pa.array(stay))

    return docs.select("*", F.lower(text_col).alias(judged)).mapInArrow(run, docs.schema)
