"""Sequence and text encoders, pooling, wide/array vectors, model comparison.

The default sequence encoder is a hashed k-mer composition (L2-normalised
counts of ``md5(kmer) mod n`` buckets).  It has two implementations with
identical output: ``kmer_profile`` (an Arrow-batched pandas UDF that builds
each histogram with numpy in one pass, no shuffle -- the fast path) and
``kmer_profile_sql`` (explode + partial aggregate, pure SQL -- the
reference for the oracle and for engines without Python workers).
A real protein model plugs in through ``model_encoder`` (``predict_batch_udf``).
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import beside, list_parts

N_SEQ_BUCKETS = 64
N_TEXT_BUCKETS = 384
MAX_TABLE_K = 3  # k-mers up to this length have a table of buckets (26**k rows)


def md5_bucket(x: Column, n: int) -> Column:
    """``int(md5(x)[:8], 16) % n`` -- the bucket rule shared with SQL."""
    return (F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % F.lit(n)).cast("int")


def _py_bucket(s: str, n: int) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16) % n


@lru_cache(maxsize=8)
def _kmer_table(k: int, n: int) -> np.ndarray:
    """Bucket of every upper-case k-mer, indexed by its base-26 code."""
    letters = [chr(65 + i) for i in range(26)]
    return np.array([_py_bucket("".join(t), n) for t in itertools.product(letters, repeat=k)],
                    dtype=np.int64)


def _profile(seq: str, k: int, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.float64)
    if seq is None or len(seq) < k:
        return out
    b = np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8).astype(np.int64) - 65
    if b.min() >= 0 and b.max() < 26:
        m = len(b) - k + 1
        code = np.zeros(m, dtype=np.int64)
        for i in range(k):
            code = code * 26 + b[i:i + m]
        out += np.bincount(_kmer_table(k, n)[code], minlength=n)
    else:  # letters outside A-Z: hash each k-mer (rare)
        for i in range(len(seq) - k + 1):
            out[_py_bucket(seq[i:i + k], n)] += 1
    norm = np.sqrt(np.dot(out, out))
    return out / norm if norm > 0 else out


def kmer_profile(seq: Column, k: int = 3, n: int = N_SEQ_BUCKETS) -> Column:
    """ML1 default encoder (fast path): ARRAY<DOUBLE> of length ``n``; null for
    a null sequence.  Marked non-deterministic so that the optimiser neither
    repeats it nor pushes a filter on its result below it."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _enc(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _profile(x, k, n) for x in s])

    return _enc.asNondeterministic()(seq)


def kmer_profile_sql(df: DataFrame, id_col: str, seq_col: str = "seq", k: int = 3,
                     n: int = N_SEQ_BUCKETS) -> DataFrame:
    """ML1 default encoder in SQL: long format ``(id, bucket, value)``.

    Positions are exploded inside the scan task and counted with a partial
    aggregate, so at most ``n`` rows per sequence reach the shuffle.
    """
    # letters once per row: a substring counts its way from the start of the text
    d = df.select(id_col, F.split(F.col(seq_col), "").alias("_ch"), F.length(seq_col).alias("_L"))
    pos = F.when(F.col("_L") >= k, F.sequence(F.lit(1), F.col("_L") - k + 1)).otherwise(F.array().cast("array<int>"))
    kmers = F.transform(pos, lambda p: F.concat(*[F.element_at(F.col("_ch"), p + i) for i in range(k)]))
    km = d.select(id_col, F.explode(kmers).alias("_kmer"))
    if k > MAX_TABLE_K:
        return _normalised_counts(km.select(id_col, md5_bucket(F.col("_kmer"), n).alias("bucket")), id_col)
    # the digest of an A-Z k-mer is taken once, not at each of its places
    letter = [F.char(F.lit(65) + F.floor(F.col("id") / 26 ** i).cast("bigint") % 26) for i in range(k)]
    table = df.sparkSession.range(26 ** k).select(F.concat(*letter).alias("_kmer"))
    table = table.select("_kmer", md5_bucket(F.col("_kmer"), n).alias("_b"))
    found = km.join(F.broadcast(table), "_kmer", "left")
    bucket = F.when(F.col("_b").isNull(), md5_bucket(F.col("_kmer"), n)).otherwise(F.col("_b"))
    return _normalised_counts(found.select(id_col, bucket.alias("bucket")), id_col)


def _normalised_counts(items: DataFrame, id_col: str) -> DataFrame:
    """Counts per (id, bucket), L2-normalised per id.  The norm is a window
    over one id's buckets (at most ``n`` rows), not a second aggregate and a
    join."""
    from pyspark.sql import Window
    counts = items.groupBy(id_col, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    norm = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "bucket", (F.col("_n") / norm).alias("value"))


def long_to_array(long_df: DataFrame, id_col: str, n: int, out: str = "embedding") -> DataFrame:
    """(id, bucket, value) rows -> one dense ARRAY<DOUBLE> per id (<= n
    entries collected per id)."""
    g = long_df.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("_m"))
    return g.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(
        F.try_element_at(F.col("_m"), b), F.lit(0.0))).alias(out))


def embed_sequences(df: DataFrame, seq_col: str = "seq", out: str = "embedding",
                    k: int = 3, n: int = N_SEQ_BUCKETS, encoder=None) -> DataFrame:
    """ML1: add a fixed-width vector per sequence.

    ``encoder`` is a callable ``Column -> Column`` (e.g. ``model_encoder``);
    the default is the hashed k-mer profile.  Whole sequences are encoded.
    """
    enc = encoder or (lambda c: kmer_profile(c, k, n))
    return df.withColumn(out, enc(F.col(seq_col)))


def model_encoder(make_predict_fn, dim: int, batch_size: int = 250):
    """Plug-in encoder: ``make_predict_fn()`` returns ``f(np.ndarray[str])
    -> np.ndarray[batch, dim]``; loaded once per Python worker and called on
    Arrow batches.  ``predict_batch_udf`` is planned once (not re-evaluated
    above a filter), so cheap filters written before it stay below it."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size)
    return lambda c: udf(c)


def padded_batches(lengths, budget: int, max_rows: int) -> list[np.ndarray]:
    """Positions of ``lengths`` in batches, longest first: ``rows * longest <= budget``
    (a longer item is a batch of its own) and ``rows <= max_rows``."""
    order = np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable")
    out, at = [], 0
    while at < len(order):
        rows = max(1, min(max_rows, budget // max(1, int(lengths[order[at]]))))
        out.append(order[at:at + rows])
        at += rows
    return out


def budget_encoder(make_predict_fn, dim: int, token_budget: int = 4096, extra: int = 2, max_rows: int = 250):
    """Plug-in encoder whose batches hold at most ``token_budget`` padded tokens (a
    sequence's residues and ``extra`` special ones), as an accelerator's memory asks
    for.  ``make_predict_fn()`` is called once per Python worker and returns
    ``f(list[str]) -> array[batch, dim]``.  Each Arrow batch is cut by length and put
    back in row order; null sequences get null vectors and are never encoded."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for seqs in batches:
            out = np.empty(len(seqs), dtype=object)
            there = np.flatnonzero(seqs.notna().to_numpy())
            texts = [seqs.iloc[i] for i in there]
            for rows in padded_batches([len(t) + extra for t in texts], token_budget, max_rows):
                found = np.asarray(predict([texts[i] for i in rows]), dtype=np.float32)
                if found.shape != (len(rows), dim):
                    raise ValueError(f"the encoder gave {found.shape} for {len(rows)} sequences of {dim} values")
                for i, vector in zip(rows, found):
                    out[there[i]] = vector
            yield pd.Series(out)

    udf = _enc.asNondeterministic()  # planned once, as in ``model_encoder``
    return lambda c: udf(c)


def text_profile(text: Column, n: int = N_TEXT_BUCKETS) -> Column:
    """ML2 default encoder: hashed bag of the lower-cased ``\\W+`` words of the
    whole text, L2-normalised; null for a null text.  All words of a row are
    counted in its own task: no shuffle."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _enc(words: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(row):
            if row is None:
                return None
            out = np.zeros(n, dtype=np.float64)
            for w in row:
                if w:
                    b = known.get(w)
                    if b is None:
                        b = known[w] = _py_bucket(w, n)
                    out[b] += 1
            norm = np.sqrt(np.dot(out, out))
            return out / norm if norm > 0 else out
        return words.map(one, na_action=None).astype("object")

    return _enc.asNondeterministic()(F.split(F.lower(text), r"\W+"))


def embed_annotation_text(df: DataFrame, text_col: str = "text", out: str = "embedding",
                          n: int = N_TEXT_BUCKETS, encoder=None) -> DataFrame:
    """ML2: add a fixed-width vector per text.  ``encoder`` is a callable
    ``Column -> Column`` (e.g. ``model_encoder``); the default is the hashed
    bag of words."""
    enc = encoder or (lambda c: text_profile(c, n))
    return df.withColumn(out, enc(F.col(text_col)))


def vector_entries(df: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """Long format of vectors: ``(id, bucket, value)`` of the non-zero entries."""
    e = df.select(id_col, F.posexplode(vec_col).alias("bucket", "value"))
    return e.where(F.col("value") != 0.0)



# ---------------------------------------------------------------- pooling


def weighted_pool(vectors: Column, weights: Column, dim: int) -> Column:
    """sum_i w_i v_i / sum_i w_i over positions (vectors: ARRAY<ARRAY<DOUBLE>>); null
    where an array or a vector is null or the weights sum to zero.  Numpy sums Arrow
    batches, whose bytes Spark bounds, so no row makes an object per position."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def _pool(vecs: pa.Array, w: pa.Array) -> pa.Array:
        counts, inner = list_parts(vecs)
        lengths, flat = list_parts(inner)
        given = beside(counts, w)
        bad = (lengths != dim) | ~given.is_valid().to_numpy(zero_copy_only=False)
        holes = np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]
        bad[holes] = True
        row = np.repeat(np.arange(len(vecs)), counts)
        known = vecs.is_valid().to_numpy(zero_copy_only=False) & w.is_valid().to_numpy(zero_copy_only=False)
        known &= (np.bincount(row[bad], minlength=len(vecs)) == 0) & (counts == list_parts(w)[0]) & (counts > 0)
        use = known[row]
        v = flat.filter(pa.array(np.repeat(use, lengths))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = given.filter(pa.array(use)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = (np.cumsum(counts[known]) - counts[known]).astype(np.int64)
        out = np.zeros((len(vecs), dim))
        if len(starts):
            total = np.add.reduceat(x, starts)
            known[known] = total != 0
            out[known] = (np.add.reduceat(v * x[:, None], starts, axis=0) / np.where(total == 0, 1, total)[:, None])[total != 0]
        offsets = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~known))

    return _pool.asNondeterministic()(vectors, weights)


def mean_pool_residues(vectors: Column, n_residues: Column, dim: int,
                       max_residues: int | None = None) -> Column:
    """AGG24 (a): mean over residue positions 1..n (begin/end tokens out);
    ``max_residues`` cuts as a model context would (off by default)."""
    n = n_residues if max_residues is None else F.least(n_residues, F.lit(max_residues))
    v = F.slice(vectors, 2, n)
    return weighted_pool(v, F.array_repeat(F.lit(1), F.size(v)), dim)


def mean_pool_masked(vectors: Column, mask: Column, dim: int) -> Column:
    """AGG24 (b): attention-mask-weighted mean of all token vectors."""
    return weighted_pool(vectors, mask, dim)


def position_weighted_pool(vectors: Column, mask: Column, dim: int) -> Column:
    """AGG25: mean weighted by position 1, 2, 3 ... over real tokens."""
    w = F.transform(mask, lambda m, i: m * (i + 1))
    return weighted_pool(vectors, w, dim)


# ----------------------------------------------------- vectors and models


def array_to_wide(df: DataFrame, col: str, dim: int, prefix: str = "e_") -> DataFrame:
    """Vector -> ``e_0 .. e_{dim-1}`` columns."""
    return df.select(*[c for c in df.columns if c != col],
                     *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(dim)])


def wide_to_array(df: DataFrame, dim: int, prefix: str = "e_", out: str = "embedding"
                  ) -> DataFrame:
    """PRJ15: ``e_0 .. e_{dim-1}`` columns -> one vector per row."""
    wide = [f"{prefix}{i}" for i in range(dim)]
    return df.select(*[c for c in df.columns if c not in wide],
                     F.array(*[F.col(c) for c in wide]).alias(out))


def compare_models(a: DataFrame, b: DataFrame, id_col: str, vec_col: str = "embedding"
                   ) -> DataFrame:
    """JN4: embeddings of the same rows from two models, side by side:
    difference vector, L2 drift and cosine similarity."""
    x = a.select(id_col, F.transform(vec_col, lambda v: v.cast("double")).alias("_a"))
    y = b.select(id_col, F.transform(vec_col, lambda v: v.cast("double")).alias("_b"))
    j = x.join(y, id_col, "inner")

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    diff = F.zip_with("_b", "_a", lambda p, q: p - q)
    return j.select(id_col, diff.alias("diff"),
                    F.sqrt(dot(diff, diff)).alias("l2_drift"),
                    (dot(F.col("_a"), F.col("_b")) /
                     (F.sqrt(dot(F.col("_a"), F.col("_a"))) * F.sqrt(dot(F.col("_b"), F.col("_b")))))
                    .alias("cosine"))
