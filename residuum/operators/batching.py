"""TOP2: length-sorted batches under a token budget (for a model encoder).

Rows in order of falling length are cut into batches of as many rows as the first,
longest one allows.  Among all cuts of a length-sorted list this makes the fewest
batches.  The cut needs only the table of (length, rows): where a length's rows begin
to open batches of their own, and how many of them still fill the batch that a greater
length opened.  That table has a row for each length that occurs; it is folded in one
``aggregate``, joined back, and a row's batch follows from its rank among the rows of
its length (exact, in buckets, so a length of very many rows is not one task's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.hashing import hash_bucket, rank_key
from residuum.operators.ranking import row_index

SEED = "batches"


def batch_plan(lengths: DataFrame, budget: int, extra: int) -> DataFrame:
    """``(length, filled, first_batch, cap)`` from ``(length, n)``: the first ``filled``
    rows of the length go to batch ``first_batch - 1``, the others ``cap`` by ``cap`` to
    batches from ``first_batch`` on."""
    entry = F.struct(F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("n"))
    table = lengths.agg(F.sort_array(F.collect_list(entry), asc=False).alias("t"))
    plan = "array<struct<length:bigint,filled:bigint,first_batch:bigint,cap:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("batches"),
                     F.array().cast(plan).alias("plan"))

    def step(a: Column, x: Column) -> Column:
        filled = F.least(a["open"], x["n"])
        cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / (x["length"] + F.lit(extra))).cast("long"))
        opened = F.ceil((x["n"] - filled) / cap).cast("long")
        row = F.struct(x["length"].alias("length"), filled.alias("filled"), a["batches"].alias("first_batch"), cap.alias("cap"))
        # rows of the length left over fill a batch in part; without any, what was open stays open
        left = F.when(opened > 0, opened * cap - (x["n"] - filled)).otherwise(a["open"] - filled)
        return F.struct(left.alias("open"), (a["batches"] + opened).alias("batches"), F.concat(a["plan"], F.array(row)).alias("plan"))

    folded = F.aggregate("t", start, step, lambda a: a["plan"])
    return table.select(F.explode(folded).alias("p")).select("p.*")


def length_bucketed_batches(df: DataFrame, id_col: str = "record_id", seq_col: str = "seq",
                            budget: int = 4096, extra: int = 1) -> DataFrame:
    """``(id, length, batch_id)`` with ``(longest + extra) * rows <= budget`` in every
    batch (a longer sequence is a batch of its own); batch ids count from 0 in order of
    falling length, rows of one length are in hash order of their id (any order for
    equal ids).  Whole sequences; a null one has length 0."""
    key = rank_key(SEED, id_col)
    d = df.select(id_col, F.coalesce(F.length(seq_col), F.lit(0)).alias("length"),
                  F.coalesce(key, F.md5(F.lit(""))).alias("_key"))
    ranked = row_index(d, "length", ["_key"], hash_bucket(F.col("_key")), "_rank")
    plan = batch_plan(d.groupBy("length").agg(F.count(F.lit(1)).alias("n")), budget, extra)
    p = plan.select(F.col("length").alias("_length"), "filled", "first_batch", "cap")
    own = F.col("first_batch") + F.floor((F.col("_rank") - F.col("filled")) / F.col("cap")).cast("long")
    return ranked.join(p, ranked["length"] == p["_length"]).select(
        id_col, "length", F.when(F.col("_rank") < F.col("filled"), F.col("first_batch") - 1).otherwise(own).alias("batch_id"))
