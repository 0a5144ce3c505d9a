"""N-gram Jaccard self-join: MinHash banding, then full verification.

1. One pass over the texts makes each text's set of hashed word n-grams, its
   128-bit set hash and its MinHash band hashes. The number of rows of a band is
   the largest for which some number of bands, within ``max_hashes``, reaches the
   target recall at the threshold.
2. Texts with equal sets form a class; only one representative goes on. Class
   sizes carry the copies' links.
3. Representatives are shuffled on band hashes. Each is linked to the smallest of
   its bucket (a star, not all pairs), which gives candidate groups.
4. In a candidate group all pairs are verified on the full n-gram sets. Groups
   are cut into blocks of ``BLOCK`` representatives, and a task sees two blocks
   at a time, so a group of any size is whole and no task or row holds it all.
   Pairs are counted inside the task and never become rows. A group of more than
   ``LARGE`` blocks, which shared boilerplate may chain up from many small ones, is
   not verified as a whole: its texts go to each of their buckets, and a pair
   counts in the bucket of the first band that it shares. So a text is sent for
   each block of its buckets and not for each of the chain.
5. Verified links are joined up to groups (connected components).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A text of fewer words than n has one
gram, all its words; a text without words (null, empty, blank) has none, links to
nothing and is a group of its own. Rows with a null id take no part: class_id null,
no links. Repeated rows (same id and text) count as copies of each other. Extra
columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import as_binary, give_back, slices
from residuum.llm.components import components
from residuum.llm.wordhash import Grams, mix, row_bounds, words

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.998
MAX_HASHES = 128
BLOCK = 512        # representatives in a block of a candidate group
LARGE = 8          # blocks of a group beyond which its buckets are verified instead
PACK = 1024        # small groups share a task's group of about so many representatives
COLUMNS = 8192     # n-grams handled at once when pairs are counted


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES):
    """``(bands, rows)``: the most rows (fewest false candidates) that reach the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 0 else math.inf
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall within max_hashes")
    return best


def gram_sets(data: np.ndarray, off: np.ndarray, n: int):
    """``(row, gram)`` of each text's distinct n-grams, in order."""
    row, h = words(data, off)
    bounds = row_bounds(row, len(off) - 1)
    count = np.diff(bounds)
    grams = Grams(h)
    at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    row = np.concatenate([row[at], short])
    g = np.concatenate([grams.of(at, at + n), grams.of(bounds[short], bounds[short + 1])])
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(g) != 0)
    return row[new], g[new]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def set_keys(g: np.ndarray, start: np.ndarray) -> list[bytes]:
    """128-bit hash of each set of grams; ``start``: where the sets begin."""
    if not len(start):
        return []
    sums = [np.add.reduceat(mix(g ^ np.uint64(s)), start) for s in (0x5BD1E995, 0xC2B2AE3D)]
    key = np.stack(sums, axis=1).tobytes()
    return [key[i:i + 16] for i in range(0, len(key), 16)]


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20240601)
    mul = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64)

    def run(batches):
        for b in batches:
            for first, data, off in slices(as_binary(b.column(2))):
                row, g = gram_sets(data, off, n)
                start = np.flatnonzero(np.diff(row, prepend=-1))
                have = row[start]
                band = np.zeros((len(have), bands), np.uint64)
                if len(have):
                    for j in range(bands * rows):
                        low = np.minimum.reduceat(g * mul[j] + add[j], start)
                        band[:, j // rows] = mix(band[:, j // rows] + low)
                    band = mix(band ^ np.arange(1, bands + 1, dtype=np.uint64))
                pick = pa.array(have + first, pa.int64())
                yield pa.record_batch(
                    [b.column(0).take(pick), b.column(1).take(pick), pa.array(set_keys(g, start), pa.binary()),
                     pa.array(np.diff(np.append(start, len(row))), pa.int32()),
                     pa.ListArray.from_arrays(np.arange(len(have) + 1, dtype=np.int32) * bands, _signed(band.ravel()))],
                    ["id", "th", "key", "n", "bands"])
            give_back()
    return run


def _sets(n: int):
    """N-gram set of each representative's text (``key`` guards against another text of
    its hash)."""
    def run(batches):
        for b in batches:
            for first, data, off in slices(as_binary(b.column(1))):
                row, g = gram_sets(data, off, n)
                start = np.flatnonzero(np.diff(row, prepend=-1))
                bounds = np.append(start, len(row)).astype(np.int32)
                part = b.take(pa.array(row[start] + first, pa.int64()))
                grams = pa.ListArray.from_arrays(bounds, _signed(g))
                right = pa.array([x == y.as_py() for x, y in zip(set_keys(g, start), part.column("key"))], pa.bool_())
                yield pa.record_batch([*part.columns[2:], grams], [*b.schema.names[2:], "grams"]).filter(right)
            give_back()
    return run


def _pairs(sets: list[np.ndarray], share: Fraction) -> np.ndarray:
    """Which pairs have ``|a & b| >= share * |a | b|``."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    gram, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    row, at = row[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    top = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, top, COLUMNS):
        a, z = np.searchsorted(at, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, top - lo)), np.float32)
        x[row[a:z], at[a:z] - lo] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return share.denominator * both >= share.numerator * union


def first_shared(bands: np.ndarray, h: int) -> np.ndarray:
    """Which pairs of rows have ``h`` as the first of their equal bands."""
    first = np.zeros((len(bands), len(bands)), np.int64)
    for band in bands.T[::-1]:
        same = band[:, None] == band[None, :]
        first[same] = np.broadcast_to(band, same.shape)[same]
    return first == h


def verify(group: pa.Table, share: Fraction) -> pa.Table:
    """Links of a pair of blocks. Columns: comp, blk, i, j, key, size, grams, and for
    buckets their hash ``h`` and ``bands`` (else null)."""
    key, root, links = [], [], []
    if len(group):
        group = group.sort_by([("comp", "ascending"), ("key", "ascending")]).combine_chunks()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        keys, comps = group.column("key").to_pylist(), group.column("comp").to_pylist()
        sizes, blks = np.asarray(group.column("size")), np.asarray(group.column("blk"))
        grams = group.column("grams").combine_chunks()
        values, off = np.asarray(grams.values), np.asarray(grams.offsets)
        buckets, bands = group.column("h").to_pylist(), group.column("bands")
        lo = 0
        while lo < len(keys):
            at = [lo]  # rows of one candidate group, once each
            hi = lo + 1
            while hi < len(keys) and comps[hi] == comps[lo]:
                if keys[hi] != keys[hi - 1]:
                    at.append(hi)
                hi += 1
            lo = hi
            if len(at) < 2:
                continue
            linked = _pairs([values[off[r]:off[r + 1]] for r in at], share)
            np.fill_diagonal(linked, False)
            if buckets[at[0]] is not None:
                linked &= first_shared(np.array([bands[r].as_py() for r in at], np.int64), buckets[at[0]])
            if i != j:
                linked &= blks[at][:, None] != blks[at][None, :]
            n_links = linked @ sizes[at]
            label = np.arange(len(at))
            for r in range(len(at)):  # join up what links inside this pair of blocks
                to = label[linked[r]]
                if len(to):
                    low = min(to.min(), label[r])
                    label[np.isin(label, np.append(to, label[r]))] = low
            for r, a in enumerate(at):
                if n_links[r]:
                    key.append(keys[a])
                    root.append(keys[at[label[r]]])
                    links.append(int(n_links[r]))
    give_back()
    return pa.table({"key": pa.array(key, pa.binary()), "root": pa.array(root, pa.binary()),
                     "links": pa.array(links, pa.int64())})


HAS_WORD = r"[^\x20\x09-\x0D]"


def linked_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL,
                   max_hashes: int = MAX_HASHES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(id, th, key)`` of each row with an id and words, ``th`` the hash of its text and
    ``key`` its n-gram set, and for each key ``(key, comp, rep, n_links)``: its group of
    linked texts, the smallest ``(id, th)`` with this set, and how many other rows a row
    of it is similar to (copies included)."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    share = Fraction(threshold).limit_denominator(10_000)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")) \
        .filter(F.col("id").isNotNull())
    sig = src.mapInArrow(_signatures(n, bands, rows), "id bigint, th bigint, key binary, n int, bands array<bigint>")
    # one row for each text with words: its key, and for the class its size and first id
    sig = sig.checkpoint()
    classes = sig.groupBy("key").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("size"),
                                     F.any_value("bands").alias("bands")).checkpoint()
    in_bucket = classes.select("key", F.explode("bands").alias("h"))
    low = in_bucket.groupBy("h").agg(F.min("key").alias("low"), F.count("*").alias("m")).filter("m > 1")
    shared = in_bucket.join(low, "h").select("key", "low", F.struct("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb")).alias("bucket")) \
        .checkpoint()
    cand = components(shared.select("key", "low"))

    blocks = cand.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.count("*").alias("m")).checkpoint()
    packs = max(1, math.ceil((blocks.agg(F.sum("m")).first()[0] or 0) / PACK))
    reps = cand.join(blocks.select("comp", "nb"), "comp").join(
        classes.select(F.col("key").alias("node"), "rep", "size", "bands"), "node")
    # the buckets of texts in large groups, one for each band at most
    large = cand.join(blocks.filter(F.col("nb") > LARGE).select("comp"), "comp").select(F.col("node").alias("key"))
    buckets = shared.join(large, "key").groupBy(F.col("key").alias("node")).agg(F.collect_list("bucket").alias("buckets"))
    reps = reps.join(buckets, "node", "left").withColumn("bands", F.when(F.col("buckets").isNotNull(), F.col("bands")))
    texts = src.join(reps.select("rep.id", "rep.th", F.col("node").alias("want"), "comp", "nb", "size", "bands", "buckets"), ["id", "th"]) \
        .select("id", "text", "comp", "nb", F.col("want").alias("key"), "size", "bands", "buckets")
    groups = F.coalesce("buckets", F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.col("nb").alias("nb"))))
    dealt = texts.mapInArrow(_sets(n), "comp binary, nb int, key binary, size bigint, bands array<bigint>, "
                             "buckets array<struct<h:bigint,nb:int>>, grams array<bigint>") \
        .withColumn("to", F.explode(groups)).withColumns({"h": F.col("to.h"), "nb": F.col("to.nb")}) \
        .withColumn("comp", F.when(F.col("h").isNull(), F.col("comp")).otherwise(F.encode(F.hex("h"), "utf-8"))) \
        .withColumn("blk", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))) \
        .select("comp", "h", "bands", "key", "size", "grams", "blk", F.least("blk", "other").alias("i"),
                F.greatest("blk", "other").alias("j"),
                F.when(F.col("nb") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp")).alias("g"))
    found = dealt.groupBy("g", "i", "j").applyInArrow(lambda t: verify(t, share), "key binary, root binary, links bigint") \
        .checkpoint()
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(found.select("key", "root"))
    group = classes.select("key", "rep", "size").join(links, "key", "left") \
        .join(comp.withColumnRenamed("node", "key"), "key", "left") \
        .select("key", "rep", F.coalesce("comp", "key").alias("comp"),
                (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return sig.select("id", "th", "key"), group


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(id, class_id, n_links)`` for each row: the smallest id of its group of
    linked texts, and how many other rows are similar to it (copies included)."""
    rows, group = linked_classes(docs, id_col=id_col, text_col=text_col, **how)
    first = group.groupBy("comp").agg(F.min("rep.id").alias("class_id"))
    by_key = group.join(first, "comp").select("key", "class_id", "n_links")
    with_words = rows.select("id", "key").join(by_key, "key").select("id", "class_id", "n_links")
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col)
    rest = docs.filter(id_.isNull() | text.isNull() | ~text.rlike(HAS_WORD)) \
        .select(id_.alias("id"), id_.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return with_words.unionByName(rest).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without its near duplicates: of each group of linked texts one row stays,
    with all columns, that of the smallest id, and of several texts of this id the one of
    least hash. Ids need not be unique: texts that are linked with no other all stay.
    Rows with a null id or without words are not compared and stay."""
    _, group = linked_classes(docs, id_col=id_col, text_col=text_col, **how)
    kept = group.groupBy("comp").agg(F.min("rep").alias("rep")) \
        .select(F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"))
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col)
    compared = id_.isNotNull() & text.isNotNull() & F.coalesce(text.rlike(HAS_WORD), F.lit(False))
    found = docs.filter(compared).join(kept, (id_ == F.col("_id")) & (F.xxhash64(text_col) == F.col("_th")))
    # repeated rows: the first of them, with a partial limit before the shuffle
    nth = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
    return found.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth", "_id", "_th").unionByName(docs.filter(~compared))
