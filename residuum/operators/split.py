"""Reproducible splits: family-disjoint, stratified, random, top-n per group.

All orders are ``md5(seed ':' key)``; sizes are exact.  None of the splits
sorts or windows the whole input in one task (see ``ranking``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions.hashing import hash_bucket, rank_key
from residuum.operators.curate import family_partition
from residuum.operators.ranking import ordered_cumsum, prefix_select

NULL_CLASS = "\u0000null"


def _family_table(df: DataFrame, family_col: str, seed) -> DataFrame:
    """Rows per family (null is one), with the families' hash order."""
    return (df.groupBy(family_col).agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("_h", rank_key(seed, family_col)))


def _chosen(fam: DataFrame, frac, family_col: str) -> DataFrame:
    lim = fam.agg((F.sum("n_rows") * F.lit(Decimal(str(frac)))).alias("limit"))
    named = fam.where(F.col(family_col).isNotNull())
    return prefix_select(named, F.col("_h"), F.col(family_col), lim, weight=F.col("n_rows")).where("selected")


def choose_test_families(df: DataFrame, frac=0.2, seed=42,
                         family_col: str = "family") -> DataFrame:
    """WIN1 core: families moved to test, in hash order, until the moved
    rows reach ``frac`` of all rows (null-family rows count in the total);
    the family that crosses the line is moved too."""
    return _chosen(_family_table(df, family_col, seed), frac, family_col).select(family_col, "n_rows")


def family_split(df: DataFrame, frac=0.2, seed=42, family_col: str = "family") -> DataFrame:
    """WIN1: whole families to test; adds ``split`` in {train, test}."""
    return family_partition(df, choose_test_families(df, frac, seed, family_col), family_col)


def split_progress(df: DataFrame, frac=0.2, seed=42, family_col: str = "family") -> DataFrame:
    """WIN2: running share of rows and of families as test families are moved."""
    fam = _family_table(df, family_col, seed)
    moved = _chosen(fam, frac, family_col).drop("selected")
    cum = ordered_cumsum(moved, None, ["_h", family_col], hash_bucket(F.col("_h")),
                         F.col("n_rows"), "cum_rows")
    cum = ordered_cumsum(cum, None, ["_h", family_col], hash_bucket(F.col("_h")),
                         F.lit(1), "cum_families")
    totals = fam.agg(F.sum("n_rows").alias("_total"), F.count(family_col).alias("_nfam"))
    return (cum.crossJoin(F.broadcast(totals))
               .select(family_col, "n_rows", "cum_rows", "cum_families",
                       F.round(F.col("cum_rows") * 100.0 / F.col("_total"), 6).alias("pct_rows"),
                       F.round(F.col("cum_families") * 100.0 / F.col("_nfam"), 6)
                        .alias("pct_families")))


def stratified_quotas(df: DataFrame, class_col: str = "class", frac=0.1) -> DataFrame:
    """Held-out rows per class of ``df`` (see ``_quotas``)."""
    counts = (df.withColumn("_sk", F.coalesce(F.col(class_col), F.lit(NULL_CLASS)))
              .groupBy("_sk").agg(F.count(F.lit(1)).alias("total")))
    return _quotas(counts, frac)


def _quotas(counts: DataFrame, frac) -> DataFrame:
    """Held-out rows per class, as the common stratified splitter does it.

    ``n_test = ceil(frac * n)`` (exact decimal); training quotas by largest
    remainder of ``n_train * c / n`` (integer arithmetic, ties by class),
    then test quota = class size - training quota.  ``counts`` has one row
    per class: ``(_sk, total)``.
    """
    cc = counts.select("_sk", F.col("total").alias("c"))
    every = Window.partitionBy()
    q = (cc.withColumn("n", F.sum("c").over(every))
           .withColumn("n_test", F.ceil(F.col("n") * F.lit(Decimal(str(frac)))).cast("long"))
           .withColumn("n_train", F.col("n") - F.col("n_test"))
           .withColumn("f", F.expr("(n_train * c) div n"))
           .withColumn("r", F.expr("(n_train * c) % n"))
           .withColumn("need", F.col("n_train") - F.sum("f").over(every))
           .withColumn("rk", F.row_number().over(Window.orderBy(F.desc("r"), "_sk")))
           .withColumn("train_q", F.col("f") + F.when(F.col("rk") <= F.col("need"), 1)
                       .otherwise(0))
           .select("_sk", F.col("c").alias("n_class"), "train_q",
                   (F.col("c") - F.col("train_q")).alias("limit")))
    return q


def stratified_split(df: DataFrame, class_col: str = "class", frac=0.1, seed=42,
                     key_col: str = "record_id", test_name: str = "validation",
                     train_name: str = "train") -> DataFrame:
    """WIN3: class-proportional exact split; adds ``split``."""
    d = df.withColumn("_sk", F.coalesce(F.col(class_col), F.lit(NULL_CLASS)))
    sel = prefix_select(d, rank_key(seed, key_col), F.col(key_col),
                        lambda counts: _quotas(counts, frac), ["_sk"])
    return sel.withColumn("split", F.when(F.col("selected"), F.lit(test_name))
                          .otherwise(F.lit(train_name))).drop("selected", "_sk")


def chunk_split(chunks: DataFrame, class_col: str = "class", frac=0.1, seed=42,
                key_col: str = "record_id", **names) -> DataFrame:
    """WIN3 on chunks: chunks, not records, are dealt to the splits, so pieces of
    one record may fall on both sides (the source's older behaviour; split
    records first to keep them together)."""
    key = F.concat_ws(":", F.col(key_col), F.col("chunk_id"))
    return stratified_split(chunks.withColumn("_chunk_key", key), class_col, frac, seed, "_chunk_key",
                            **names).drop("_chunk_key")


def random_split(df: DataFrame, test_frac=0.2, seed=42, key_col: str = "record_id") -> DataFrame:
    """WIN4: exact ``ceil(frac * n)`` test rows in hash order, not stratified."""
    sel = prefix_select(df, rank_key(seed, key_col), F.col(key_col),
                        lambda t: t.withColumn("limit", F.ceil(
                            F.col("total") * F.lit(Decimal(str(test_frac)))).cast("long")))
    return sel.withColumn("split", F.when(F.col("selected"), F.lit("test"))
                          .otherwise(F.lit("train"))).drop("selected")


def topn_per_group(df: DataFrame, group_col: str, n: int, seed=42,
                   key_col: str = "record_id") -> DataFrame:
    """WIN5: at most ``n`` rows per group, hash order.  Spark limits every
    group on the map side first, so a hot group sends n rows per task."""
    first = Window.partitionBy(group_col).orderBy(rank_key(seed, key_col), key_col)
    return df.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= int(n)).drop("_nth")
