"""Running sums over positions that keep no long group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12  # positions a block: one task sums a block, or one row for each block of a group


def running_sums(df: DataFrame, group: str, position: str, sums: Sequence[str]) -> DataFrame:
    """Replace each column of ``sums`` by its inclusive running sum over ``position``
    (distinct, from 0) in its ``group``. Rows are shuffled once, by group and block of
    positions; the sums of earlier blocks come from a table of one row a block."""
    block = F.shiftright(position, BLOCK_BITS).alias("_block")
    rows = df.select("*", block)
    within = Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(group, "_block").agg(*[F.sum(s).alias(s) for s in sums]) \
        .select(F.col(group).alias("_group"), F.col("_block").alias("_of"),
                *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums])
    local = rows.select(*[c for c in df.columns if c not in sums], "_block",
                        *[F.sum(s).over(within).alias(s) for s in sums])
    return local.join(blocks, (F.col(group) == F.col("_group")) & (F.col("_block") == F.col("_of"))) \
        .select(*[(F.col(c) + F.col(f"_before_{c}")).alias(c) if c in sums else F.col(c) for c in df.columns])
