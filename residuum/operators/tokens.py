"""Residue tokens, padding, masked-token corpus and batch ids.

All per-position work runs on the row's arrays in the scan's tasks, without
exploding residues into rows: token ids and masks with numpy on Arrow batches,
the rest with higher-order SQL functions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import (NO_VALUE, below, beside, in_slices, keyed, list_like, list_parts, pieces,
                                        position_words, text_parts)
from residuum.functions.residues import (CLS_ID, EOS_ID, ESM_TOKENS, IGNORE_LABEL, MASK_ID,
                                         PAD_ID, UNK_ID)
from residuum.operators.ranking import row_index

# A digest below these prefixes has probability 0.15 / 0.8 / 0.9.
P15 = "26666666"
P80 = "cccccccc"
P90 = "e6666666"


def truncate_labels(labels: Column, max_length: int) -> Column:
    """PRJ8: first ``max_length`` labels."""
    return F.slice(labels, 1, int(max_length))


# token of every byte; a letter of several bytes is one unknown token
_TOKEN = np.full(256, UNK_ID, dtype=np.int32)
for _i, _t in enumerate(ESM_TOKENS):
    if len(_t) == 1:
        _TOKEN[ord(_t)] = _i


def residue_ids(seq: Column, packed: bool = False, add_special: bool = False) -> Column:
    """Token id of every letter; empty for a null sequence.  ``packed``: one byte an id."""

    def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = text_parts(texts)
        first = (data & 0xC0) != 0x80  # bytes that begin a letter
        if first.all():
            return offsets, _TOKEN[data]
        return np.concatenate(([0], np.cumsum(first, dtype=np.int64)))[offsets], _TOKEN[data[first]]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @in_slices
    def _ids(texts: pa.Array) -> pa.Array:
        letters, values = ids(texts)
        return pa.ListArray.from_arrays(pa.array(letters.astype(np.int32)), pa.array(values))

    @F.arrow_udf(T.BinaryType())
    @in_slices
    def _packed(texts: pa.Array) -> pa.Array:
        letters, values = ids(texts)
        if add_special:
            values = np.insert(values, np.stack([letters[:-1], letters[1:]], axis=1).ravel(), [CLS_ID, EOS_ID] * len(texts))
            letters = letters + 2 * np.arange(len(letters))
        whole = pa.nulls(len(texts)).is_null()
        return pieces(whole, letters, values.astype(np.int8), pa.binary())

    if packed:
        return _packed.asNondeterministic()(seq)
    return _ids.asNondeterministic()(F.coalesce(seq, F.lit("")))


def tokenize_residues(seq: Column, max_length: int | None = 512,
                      add_special: bool = False, packed: bool = False) -> Column:
    """PRJ9: one token id per residue (unknown letters -> ``<unk>``), cut to
    ``max_length`` residues (``None``: whole sequence, for encoders without
    a context limit); optional begin/end tokens around them.  ``packed`` gives
    the ids one byte each (``digests.list_parts``), as ``mlm_mask`` and the token
    metrics take them too: an array of integers is copied value by value
    at every step between the JVM and Python."""
    s = seq if max_length is None else F.substring(seq, 1, int(max_length))
    if packed:
        return residue_ids(s, packed, add_special)
    ids = residue_ids(s)
    if add_special:
        ids = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(EOS_ID)))
    return ids


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def assign_batches(df: DataFrame, batch_size: int, group_cols=None,
                   order_col: str = "record_pos", out: str = "batch_id") -> DataFrame:
    """PRJ16: consecutive groups of ``batch_size`` rows in record order
    (per file when ``group_cols`` names the file).  The exact row index is
    computed per (group, position bucket) on narrow rows, so one huge file does
    not become one task; give it a narrow frame and join (see ``pad_batch``)."""
    idx = row_index(df, group_cols, [order_col], F.shiftright(F.col(order_col), 12), "_ri")
    return idx.withColumn(out, F.floor(F.col("_ri") / F.lit(int(batch_size))).cast("long")
                          ).drop("_ri")


def pad_batch(df: DataFrame, batch_size: int, ids_col: str = "input_ids", order_col: str = "record_pos",
              batch_col: str = "batch_id") -> DataFrame:
    """PRJ10: batches of ``batch_size`` rows in ``order_col`` (unique) order; every
    id array is padded to the longest of its batch, with mask 0 on pads.

    Batch ids and longest lengths are computed on (position, length) rows; the
    arrays themselves cross the network once, in the join."""
    sizes = df.select(order_col, F.size(ids_col).alias("_n"))
    longest = F.max("_n").over(Window.partitionBy(batch_col))  # at most batch_size rows
    plan = assign_batches(sizes, batch_size, None, order_col, batch_col).withColumn("_longest", longest)
    d = df.join(plan.select(order_col, batch_col, "_longest"), order_col)
    pad = F.greatest(F.col("_longest") - F.size(ids_col), F.lit(0))
    return (d.withColumn("_pad", pad)
             .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids_col)),
                                                    F.array_repeat(F.lit(0), F.col("_pad"))))
             .withColumn(ids_col, F.concat(F.col(ids_col), F.array_repeat(F.lit(PAD_ID), F.col("_pad"))))
             .drop("_pad", "_longest"))


def mlm_mask(df: DataFrame, ids_col: str = "input_ids", key_col: str = "record_id",
             seed=42, mlm_probability_prefix: str = P15, ignore_others: bool = True) -> DataFrame:
    """PRJ11 + PRJ12: masked-token corpus.

    ``labels`` starts as a copy of the ids; each non-special position is a
    target with probability 0.15 (digest of ``seed:key:pos``).  Non-target
    labels become -100, or stay a copy with ``ignore_others=False``.  Of the targets, 80 % become ``<mask>``, 10 % a
    random token of the whole vocabulary, 10 % stay.
    """
    specials = [CLS_ID, EOS_ID, PAD_ID]
    kind = df.schema[ids_col].dataType
    out = T.StructType([T.StructField("labels", kind), T.StructField("ids", kind)])

    # one digest per position: digits 1-8 choose the targets, 9-16 the kind of
    # replacement, 17-24 the random token
    @F.arrow_udf(out)
    @in_slices
    def _mask(ids: pa.Array, key: pa.Array) -> pa.Array:
        counts, values = list_parts(ids)
        t = values.fill_null(IGNORE_LABEL).to_numpy(zero_copy_only=False)
        h = position_words(seed, key.to_pylist(), counts)
        chosen = below(h[:1], mlm_probability_prefix) & keyed(key, counts)
        for special in specials:
            chosen &= t != special
        if values.null_count:
            chosen &= values.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(chosen)
        u = h[1:, at]
        masked, labels = t.copy(), np.full_like(t, IGNORE_LABEL)
        masked[at] = np.where(below(u, P80), MASK_ID, np.where(below(u, P90), u[1] % len(ESM_TOKENS), t[at]))
        labels[at] = t[at]
        none = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
        labels = values if not ignore_others else pa.array(labels, values.type)
        parts = [list_like(ids, counts, labels), list_like(ids, counts, pa.array(masked, values.type, mask=none))]
        return pa.StructArray.from_arrays(parts, names=["labels", "ids"])

    d = df.withColumn("_mlm", _mask.asNondeterministic()(F.col(ids_col), F.col(key_col).cast("string")))
    return d.withColumn("labels", F.col("_mlm.labels")).withColumn(ids_col, F.col("_mlm.ids")).drop("_mlm")


def ignore_index(labels: Column, other: Column, packed: bool = False) -> Column:
    """FLT3: pairs ``(label, other)`` whose label is not -100."""
    if packed:
        return _kept_pairs(labels, other)
    z = F.arrays_zip(labels.alias("label"), other.alias("other"))
    return F.filter(z, lambda x: x["label"] != F.lit(IGNORE_LABEL))


def _kept_pairs(labels: Column, other: Column) -> Column:
    @F.arrow_udf("array<struct<label: int, other: int>>")
    @in_slices
    def _pairs(labels: pa.Array, other: pa.Array) -> pa.Array:
        counts, values = list_parts(labels)
        both = labels.is_valid().to_numpy(zero_copy_only=False) & other.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(labels)), counts)
        kept = pc.not_equal(values, pa.scalar(IGNORE_LABEL, values.type)).fill_null(False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept & both[row])
        pairs = [x.take(pa.array(at)).cast(pa.int32()) for x in (values, beside(counts, other))]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(labels))))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(pairs, names=["label", "other"]),
                                        mask=pa.array(~both) if not both.all() else None)

    return _pairs.asNondeterministic()(labels, other)


def ids_md5(ids: Column) -> Column:
    """md5 of packed ids as decimal numbers joined by commas."""
    @F.arrow_udf("string")
    @in_slices
    def _md5(ids: pa.Array) -> pa.Array:
        counts, values = list_parts(ids)
        codes = values.fill_null(NO_VALUE).to_numpy(zero_copy_only=False).view(np.uint8)
        offsets, text = text_parts(_DECIMALS.take(pa.array(codes)))  # all the texts, one after the other
        ends = offsets[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return pa.array([hashlib.md5(text[s:max(s, e - 1)]).hexdigest() if known else None
                         for known, s, e in zip(ids.is_valid().to_pylist(), ends, ends[1:])], pa.string())

    return _md5.asNondeterministic()(ids)


# decimals of 0..127, -128..-1 with a comma, by the unsigned byte; null (-128) is left out,
# as array_join leaves it out
_DECIMALS = pa.array(["" if i == NO_VALUE & 255 else f"{i - (i & 128) * 2}," for i in range(256)], pa.large_string())


def n_targets(labels: Column) -> Column:
    """Number of packed labels that are not -100."""
    @F.arrow_udf("bigint")
    @in_slices
    def _n(labels: pa.Array) -> pa.Array:
        counts, values = list_parts(labels)
        real = pc.not_equal(values, pa.scalar(IGNORE_LABEL, values.type)).fill_null(False).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return pa.array(np.diff(np.concatenate(([0], np.cumsum(real)))[ends]), mask=labels.is_null().to_numpy(zero_copy_only=False))

    return _n.asNondeterministic()(labels)


def active_positions(mask: Column, labels: Column) -> Column:
    """FLT4: label where the attention mask is 1, else -100."""
    return F.zip_with(mask, labels, lambda m, l: F.when(m == 1, l).otherwise(F.lit(IGNORE_LABEL)))
