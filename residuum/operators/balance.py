"""Balanced class weights for sequence labels and residue labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import list_parts


def class_weights(df: DataFrame, class_col: str = "class") -> DataFrame:
    """AGG5: ``n / (k * n_c)`` per class present in ``df``.

    One partial aggregate over the rows, then a window over the class table
    (one row per class).
    """
    cc = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_class"))
    every = Window.partitionBy()
    return cc.select(
        class_col, "n_class",
        (F.sum("n_class").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_class")))
        .alias("weight"))


def _packed_sums(labels: Column) -> Column:
    """Number and sum of a row's packed labels; no sum where one is unknown."""
    @F.arrow_udf("struct<n: bigint, n1: bigint>")
    def _sums(labels: pa.Array) -> pa.Array:
        counts, values = list_parts(labels)
        row = np.repeat(np.arange(len(labels)), counts)
        known = values.is_valid().to_numpy(zero_copy_only=False)
        none = labels.is_null().to_numpy(zero_copy_only=False)
        total = np.bincount(row, values.fill_null(0).to_numpy(zero_copy_only=False), minlength=len(labels))
        open_ = np.bincount(row[~known], minlength=len(labels)) > 0
        return pa.StructArray.from_arrays([pa.array(counts, mask=none), pa.array(total.astype(np.int64), mask=none | open_)],
                                          names=["n", "n1"])

    return _sums.asNondeterministic()(labels)


def token_class_weights(df: DataFrame, labels_col: str = "labels") -> DataFrame:
    """AGG6: the same over every residue label, classes fixed to {0, 1}.

    Sums per row with ``aggregate`` / ``size`` (packed labels: with numpy),
    so no explode.
    """
    if isinstance(df.schema[labels_col].dataType, T.BinaryType):
        df = df.select(_packed_sums(F.col(labels_col)).alias("_s")).select("_s.*")
    else:
        df = df.select(F.size(labels_col).alias("n"),
                       F.aggregate(labels_col, F.lit(0).cast("long"), lambda a, x: a + x).alias("n1"))
    tot = df.agg(F.sum("n").cast("long").alias("n"), F.sum("n1").cast("long").alias("n1"))
    two = F.array(F.struct(F.lit(0).alias("label"), (F.col("n") - F.col("n1")).alias("n_label")),
                  F.struct(F.lit(1).alias("label"), F.col("n1").alias("n_label")))
    return tot.select("n", F.inline(two)).select(
        "label", "n_label",
        F.try_divide(F.col("n"), F.lit(2) * F.col("n_label")).alias("weight"))
