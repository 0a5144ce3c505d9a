"""Cutting sequences (and aligned residue labels) into fixed-size chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chunk_ids(seq_col: str, size: int):
    n = F.ceil(F.length(seq_col) / F.lit(float(size))).cast("int")
    # sequence(0, -1) would count down; an empty sequence gives no chunk
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>"))


def chunk_sequence(df: DataFrame, size: int = 512, seq_col: str = "seq",
                   labels_col: str | None = None) -> DataFrame:
    """PRJ6 / PRJ7: ``ceil(len/size)`` consecutive pieces per row.

    Every other column is copied; ``chunk_id`` (0-based) keeps the origin;
    ``labels_col`` (an array aligned to the sequence) is sliced in step.
    Runs inside the scan's tasks (explode is a narrow operator).
    """
    others = [c for c in df.columns if c != seq_col and c != labels_col]

    def piece(i):
        start = i * size + 1
        f = [i.alias("chunk_id"), F.substring(F.col(seq_col), start, F.lit(size)).alias(seq_col)]
        if labels_col:
            f.append(F.slice(F.col(labels_col), start, size).alias(labels_col))
        return F.struct(*f)
    # slice first, explode the pieces: no exploded row carries the whole
    # sequence
    pieces = F.transform(_chunk_ids(seq_col, size), piece)
    d = df.select(*others, F.explode(pieces).alias("_c"))
    return d.select(*others, "_c.*")
