"""Substring dedup: seed and extend on winnowed anchors.

A word that lies in a window of ``window`` consecutive words is removed if the
same word sequence also starts in a document with a smaller id. Windows are
judged on the input.

Anchors: of the ``window - K + 1`` K-grams in a window the one of least hash (the
rightmost, on ties) is its anchor, so equal windows have equal anchors at equal
places, and a document sends about one anchor for every 13 words to the join.
Extension: a document's consecutive windows with one anchor form a stretch.
Occurrences of an anchor are joined; where a whole stretch (anchor extended both
ways as far as its windows reach) also occurs in a smaller document, all of it
repeats. Where only the anchor is shared, as at the edges of a passage, the
stretch is extended window by window: each is looked up among the windows of the
first occurrence of every differing stretch with that anchor. The repeated
stretches and windows of a document join up to its maximal repeats.

Hot passages: occurrences are reduced to the smallest and largest document of a
stretch before the shuffle, so no pairs are made and no group is gathered.
Equality is judged on hashes: 64 bits of the anchor with 64 of the stretch or
window.

Null or blank texts have no words. Rows with a null id lose nothing and cause no
removal. Repeated rows (same id and text) are judged alike; rows with the same id
never remove from each other, but a text that repeats within one document does
not count either, as its id is not smaller. Extra columns are not read, unless
asked for with ``keep``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import as_binary, give_back, slices
from residuum.llm.wordhash import Grams, mix, row_bounds, words

WINDOW_WORDS = 50


def stretches(word_hash: np.ndarray, row: np.ndarray, window: int):
    """``(row, anchor, stretch, lo, n)``: first word (in the slice) and number of windows."""
    n = len(word_hash)
    k = max(1, window // 2)
    m = window - k + 1
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    grams = Grams(word_hash)
    at = np.arange(n - k + 1)
    g = grams.of(at, at + k)
    best, size = at, 1
    while size < m:  # place of the least K-gram of the next `size` ones, by doubling
        step = min(size, m - size)
        a, b = best[:len(best) - step], best[step:]
        best, size = np.where(g[b] <= g[a], b, a), size + step
    s = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    if not len(s):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    a = best[s]
    first = np.ones(len(s), bool)
    first[1:] = (np.diff(s) != 1) | (np.diff(a) != 0)
    lo = s[first]
    count = np.diff(np.append(np.flatnonzero(first), len(s)))
    place = a[first]
    whole = mix(grams.of(lo, lo + count + window - 1) ^ ((place - lo) * 64 + count).astype(np.uint64))
    return row[lo], g[place], whole, lo, count


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids as int64 and which of them are there."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _classes(window: int):
    """Smallest and largest document of each stretch of a batch."""
    def run(batches):
        for b in batches:
            ids, there = _ids(b.column(0))
            for first, data, off in slices(as_binary(b.column(1))):
                row, h = words(data, off)
                row, anchor, whole, _, _ = stretches(h, row, window)
                row = row + first
                ok = there[row]
                d, anchor, whole = ids[row[ok]], anchor[ok], whole[ok]
                order = np.lexsort((d, whole, anchor))
                d, anchor, whole = d[order], anchor[order], whole[order]
                new = np.ones(len(d), bool)
                new[1:] = (np.diff(anchor) != 0) | (np.diff(whole) != 0)
                start = np.flatnonzero(new)
                last = np.append(start[1:], len(d))[:len(start)] - 1
                yield pa.record_batch([_signed(anchor[start]), _signed(whole[start]), pa.array(d[start], pa.int64()),
                                       pa.array(d[last], pa.int64())], ["a", "r", "lo_id", "hi_id"])
            give_back()
    return run


def _occurrences(window: int):
    def run(batches):
        for b in batches:
            ids, there = _ids(b.column(0))
            keys, _ = _ids(b.column(1))
            for first, data, off in slices(as_binary(b.column(2))):
                row, h = words(data, off)
                bounds = row_bounds(row, len(off) - 1)
                row, anchor, whole, lo, count = stretches(h, row, window)
                at = lo - bounds[row]
                row = row + first
                ok = there[row]
                yield pa.record_batch(
                    [_signed(anchor[ok]), _signed(whole[ok]), pa.array(ids[row[ok]], pa.int64()),
                     pa.array(keys[row[ok]], pa.int64()), pa.array(at[ok], pa.int32()), pa.array(count[ok], pa.int32())],
                    ["a", "r", "id", "th", "at", "n"])
            give_back()
    return run


def _windows(window: int):
    """A row for each window of the open stretches of a document (``opened``, the last
    column; rows without any are passed over)."""
    def run(batches):
        for b in batches:
            b = b.filter(b.column(b.num_columns - 1).is_valid())
            opened = b.column(b.num_columns - 1).to_pylist()
            for first, data, off in slices(as_binary(b.column(2))):
                row, h = words(data, off)
                bounds, grams = row_bounds(row, len(off) - 1), Grams(h)
                which, anchor, at = [], [], []
                for i in range(len(off) - 1):
                    for o in opened[first + i]:
                        which += [i] * o["n"]
                        anchor += [o["a"]] * o["n"]
                        at += range(o["at"], o["at"] + o["n"])
                which, at = np.array(which, np.int64), np.array(at, np.int64)
                s = bounds[which] + at
                pick = pa.array(which + first, pa.int64())
                yield pa.record_batch([pa.array(anchor, pa.int64()), _signed(grams.of(s, s + window)),
                                       b.column(0).take(pick), b.column(1).take(pick), pa.array(at, pa.int32())],
                                      ["a", "w", "id", "th", "at"])
            give_back()
    return run


def repeats(rows: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``(id, th, spans)``: the repeated windows of each document as
    ``(first window, windows)``. ``rows``: ``id, th, text`` and other columns; ``th``
    tells apart texts of one id.

    The open stretches meet their texts in a left join on ``(id, th)`` with all columns
    of ``rows``, as the caller's join with the spans does, so that both read one exchange
    and the texts are written once; texts without an open stretch stay in the JVM."""
    docs = rows.select("id", "th", "text")
    classes = docs.select("id", "text").mapInArrow(_classes(window), "a bigint, r bigint, lo_id bigint, hi_id bigint")
    by_anchor = Window.partitionBy("a")
    classes = classes.repartition("a").groupBy("a", "r").agg(F.min("lo_id").alias("lo_id"), F.max("hi_id").alias("hi_id")) \
        .withColumn("kinds", F.count("*").over(by_anchor)) \
        .filter((F.col("kinds") > 1) | (F.col("lo_id") < F.col("hi_id"))).select("a", "r", "lo_id", "kinds")
    found = docs.select("id", "th", "text").mapInArrow(
        _occurrences(window), "a bigint, r bigint, id bigint, th bigint, at int, n int").join(classes, ["a", "r"]) \
        .checkpoint()  # a few bytes for each repeated stretch; read three times below
    whole = found.filter(F.col("lo_id") < F.col("id")).select("id", "th", "at", "n")
    opened = found.filter((F.col("lo_id") == F.col("id")) & (F.col("kinds") > 1)) \
        .groupBy("id", "th").agg(F.collect_set(F.struct("a", "at", "n")).alias("opened"))
    needed = F.col("opened").isNotNull()
    tried = rows.join(opened, ["id", "th"], "left") \
        .select("id", "th", *[F.when(needed, F.col(c)).alias(c) for c in rows.columns if c not in ("id", "th")], "opened") \
        .mapInArrow(_windows(window), "a bigint, w bigint, id bigint, th bigint, at int")
    first = tried.groupBy("a", "w").agg(F.min("id").alias("lo_id"), F.max("id").alias("hi_id")) \
        .filter(F.col("lo_id") < F.col("hi_id")).select("a", "w", "lo_id")
    edge = tried.join(first, ["a", "w"]).filter(F.col("lo_id") < F.col("id")) \
        .select("id", "th", "at", F.lit(1).alias("n"))
    return whole.unionByName(edge).groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_removed``, ``kept`` (the text's kept
    words joined by one space) and its ``kept_sha256`` for each row."""
    others = [c for c in keep if c != text_col]  # the text itself moves once
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"),
                       F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in others])
    spans = repeats(rows, window)
    joined = rows.join(spans, ["id", "th"], "left").select("text", "spans", *[f"k_{c}" for c in others])

    def run(batches):
        for b in batches:
            texts, spans_of = as_binary(b.column(0)).to_pylist(), b.column(1).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, found in zip(texts, spans_of):
                ws = text.split()
                gone = 0
                if found:
                    edge = np.zeros(len(ws) + 1, np.int64)
                    for s in found:
                        edge[s["at"]] += 1
                        edge[s["at"] + s["n"] + window - 1] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(ws) - int(stay.sum())
                    n_words.append(len(ws))
                    ws = [w for w, s in zip(ws, stay.tolist()) if s]
                else:
                    n_words.append(len(ws))
                n_removed.append(gone)
                kept.append(b" ".join(ws))
            own = dict(zip(others, b.columns[2:])) | {text_col: b.column(0)}
            yield pa.record_batch(
                [*[own[c] for c in keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                [*keep, "n_words", "n_removed", "kept", "kept_sha256"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(run, f"{fields}, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
