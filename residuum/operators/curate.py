"""Curation: dedupe, counts, id/family partitions, unions, exact samples."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.hashing import rank_key
from residuum.operators.ranking import prefix_select


def class_rank(class_col: Column, class_order: Sequence[str]) -> Column:
    """Position of the class in ``class_order``; unknown or null classes last."""
    pos = F.array_position(F.array(*[F.lit(c) for c in class_order]), class_col)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(class_order))).cast("int")


def dedupe_by_sequence(df: DataFrame, class_order: Sequence[str], seq_col: str = "seq",
                       order_cols: Sequence[str] = ("record_pos",),
                       class_col: str = "class", keep: Sequence[str] | None = None,
                       with_seq: bool = True) -> DataFrame:
    """AGG1: keep the first row of every distinct sequence.

    "First" is class-list order, then record order.  Rows are grouped by the
    sequence's SHA-256 with a grouped ``min(struct(rank, order..., payload...))``:
    the aggregate is partial on the map side, so a sequence repeated across a
    third of the input collapses before the shuffle, and sorts compare digests,
    not sequences.  ``keep`` limits the payload carried through the shuffle
    (struct fields inside an aggregate are not pruned by the optimizer);
    ``with_seq=False`` leaves the sequence itself out, so it never moves.
    """
    payload = [c for c in (keep if keep is not None else df.columns)
               if c != seq_col and c not in order_cols]
    d = df.withColumn("_crank", class_rank(F.col(class_col), class_order)) \
        .withColumn("_digest", F.unhex(F.sha2(F.col(seq_col), 256)))
    aggs = [F.min(F.struct("_crank", *order_cols, *payload)).alias("_first")]
    if with_seq:
        aggs.append(F.any_value(seq_col).alias(seq_col))
    out = d.groupBy("_digest").agg(*aggs)
    cols = [c for c in df.columns if (c == seq_col and with_seq) or c in order_cols or c in payload]
    return out.select(*[F.col(f"_first.{c}").alias(c) if c != seq_col else F.col(c)
                        for c in cols])


def count_per_class(df: DataFrame, class_col: str = "class") -> DataFrame:
    """AGG2: rows per class."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_records"))


def shape_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """AGG3: rows and columns per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)))


def distinct_families(df: DataFrame, family_col: str = "family") -> DataFrame:
    """AGG4: families and their row counts; null is one family value."""
    return df.groupBy(family_col).agg(F.count(F.lit(1)).alias("n_rows"))


def split_by_ids(records: DataFrame, train_ids: DataFrame, valid_ids: DataFrame,
                 keys: Sequence[str] = ("record_id", "class")) -> DataFrame:
    """JN1: route records to the split whose id list holds them.

    Records in neither list are dropped (they were deduplicated away);
    joining on id *and* class keeps a record that sits in two class files
    from being written twice.  One equi-join with the tagged id lists (a
    hash join, shuffled or broadcast by AQE when small), never a scan of
    the lists per record.
    """
    k = list(keys)
    ids = (train_ids.select(*k).distinct().withColumn("split", F.lit("train"))
           .unionByName(valid_ids.select(*k).distinct().withColumn("split", F.lit("validation"))))
    # one pass over the records; an id in both lists goes to both, as before
    return records.join(ids, k, "inner")


def family_partition(df: DataFrame, test_families: DataFrame,
                     family_col: str = "family") -> DataFrame:
    """JN2: rows of the chosen families are test, all others train.

    One left join with a flag instead of a semi and an anti join; rows with
    a null family never match, so they stay in train.
    """
    fams = test_families.select(family_col).distinct().withColumn("_in_test", F.lit(True))
    out = df.join(fams, family_col, "left")
    return out.withColumn("split", F.when(F.col("_in_test"), F.lit("test"))
                          .otherwise(F.lit("train"))).drop("_in_test")


def term_variants(terms: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """JN5: every term with every suffix (two literal tables, cross join)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    t = spark.createDataFrame([(i, x) for i, x in enumerate(terms)], "term_pos int, term string")
    s = spark.createDataFrame([(i, x) for i, x in enumerate(suffixes)],
                              "suffix_pos int, suffix string")
    return (F.broadcast(t).crossJoin(F.broadcast(s))
            .withColumn("variant", F.concat("term", "suffix")))


def union_classes(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1: concatenate per-class frames by column name; a column that a frame
    lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_all_ids(frames: Sequence[DataFrame]) -> DataFrame:
    """SET2: concatenate id lists keeping duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def exact_fraction(df: DataFrame, frac, seed, key_col: str) -> DataFrame:
    """FLT5: exactly ``round(frac * n)`` rows (half to even), hash order."""
    sel = prefix_select(df, rank_key(seed, key_col), F.col(key_col),
                        lambda t: t.withColumn("limit", F.bround(
                            F.col("total") * F.lit(Decimal(str(frac))), 0).cast("long")))
    return sel.where("selected").drop("selected")


def sample_n(df: DataFrame, n: int, seed, key_col: str) -> DataFrame:
    """FLT6: ``n`` rows in hash order (a distributed top-n)."""
    return df.orderBy(rank_key(seed, key_col), key_col).limit(int(n))


def first_row(df: DataFrame, order_col: str = "record_pos") -> DataFrame:
    """FLT7: the first record (a distributed top-1, no global sort)."""
    return df.orderBy(order_col).limit(1)
