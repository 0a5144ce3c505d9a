"""Exact ranks, running sums and ordered prefixes that survive skew.

A plain ``row_number() over (partition by g order by k)`` sends a whole
group to one task; with one group holding a third of the rows that task is
the job.  The helpers here cut each group into buckets of the ordering key
(the leading hex digits of a digest, or the high bits of a position), work
per ``(group, bucket)`` in parallel, and stitch the buckets together with
per-bucket offsets computed on a tiny ``groupBy(group, bucket)`` table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from residuum.functions.hashing import hash_bucket
from residuum.session import ensure_checkpoint_dir

UNBOUNDED = Window.unboundedPreceding


def _cols(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                    how: str) -> DataFrame:
    """Equi-join on ``keys`` where null matches null (a null group is a group).
    Buckets and their runs are never null, so they join by plain equality."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = [left[k] == r[f"_r_{k}"] if k in ("_bk", "_run", "_g0") else left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    out = left.join(r, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def _bucket_offsets(d: DataFrame, g: list[str], bucket: str, w: str) -> DataFrame:
    """Per ``(group, bucket)``: total weight and weight of earlier buckets.

    Buckets are summed up in runs (one of the first two digits of a digest, or
    65,536 positions) and the runs apart, so that no task sees more than one run
    of a group or one row for each of its runs."""
    text = isinstance(d.schema[bucket].dataType, StringType)
    run = F.substring(bucket, 1, 2) if text else F.shiftright(bucket, 16)
    stats = d.groupBy(*g, bucket).agg(F.sum(w).alias("_bw")).withColumn("_run", run)
    within = Window.partitionBy(*g, "_run").orderBy(bucket).rowsBetween(UNBOUNDED, 0)
    runs = stats.groupBy(*g, "_run").agg(F.sum("_bw").alias("_rw"))
    before = Window.partitionBy(*g).orderBy("_run").rowsBetween(UNBOUNDED, 0)
    runs = runs.withColumn("_roff", F.sum("_rw").over(before) - F.col("_rw")).drop("_rw")
    out = _join_null_safe(stats.withColumn("_boff", F.sum("_bw").over(within) - F.col("_bw")), runs, [*g, "_run"], "inner")
    return out.withColumn("_boff", F.col("_boff") + F.col("_roff")).drop("_run", "_roff")


def ordered_cumsum(df: DataFrame, group_cols, order_cols: Sequence, bucket: Column,
                   weight: Column | None = None, out: str = "cum") -> DataFrame:
    """Inclusive running sum of ``weight`` within each group in ``order_cols``.

    ``bucket`` must be a monotone function of the ordering (its leading
    part), e.g. ``hash_bucket(hex_key)`` or ``shiftright(pos, 16)``.  One
    shuffle of the rows on ``(group, bucket)``; bucket offsets are a tiny
    aggregate joined on the same keys.
    """
    g = _cols(group_cols)
    d = df.withColumn("_bk", bucket).withColumn(
        "_w", (weight if weight is not None else F.lit(1)).cast("long"))
    win = Window.partitionBy(*g, "_bk").orderBy(*order_cols).rowsBetween(UNBOUNDED, 0)
    local = d.withColumn("_loc", F.sum("_w").over(win))
    offs = _bucket_offsets(d, g, "_bk", "_w").select(*g, "_bk", "_boff")
    res = _join_null_safe(local, offs, [*g, "_bk"], "inner")
    return res.withColumn(out, F.col("_boff") + F.col("_loc")).drop("_bk", "_w", "_loc", "_boff")


def row_index(df: DataFrame, group_cols, order_cols: Sequence, bucket: Column,
              out: str = "row_idx") -> DataFrame:
    """0-based exact position of each row within its group."""
    return ordered_cumsum(df, group_cols, order_cols, bucket, F.lit(1), "_c").withColumn(
        out, F.col("_c") - 1).drop("_c")


RADIX_DIGITS = 2           # of the key, in the histogram: 256 buckets a group
BROADCAST_GROUPS = 20_000  # groups whose bounds (one narrow row each) are broadcast


def _bounds(narrow: DataFrame, g: list[str], limit) -> DataFrame:
    """Per group: the bucket in which the running weight passes the limit, and the weight
    before it.  Only the histogram moves, ``16 ** RADIX_DIGITS`` rows a group and task at
    most.  A group without a limit, or with one of nothing, has no row."""
    hist = narrow.groupBy(*g, "_b1").agg(F.sum("_w").alias("_bw"))
    before = Window.partitionBy(*g).orderBy("_b1").rowsBetween(UNBOUNDED, 0)
    hist = hist.withColumn("_before", F.sum("_bw").over(before) - F.col("_bw"))
    if callable(limit):
        limit = limit(hist.groupBy(*g).agg(F.sum("_bw").alias("total")))
    if isinstance(limit, DataFrame):
        hist = _join_null_safe(hist, limit.select(*g, F.col("limit").alias("_limit")), g, "inner")
    else:
        hist = hist.withColumn("_limit", F.lit(limit))
    return hist.where(F.col("_before") < F.col("_limit")).groupBy(*g).agg(
        F.max_by(F.struct("_b1", "_before", "_limit"), "_b1").alias("_c")).select(*g, "_c.*")


def _edge_rows(narrow: DataFrame, bounds: DataFrame, g: list[str], small: bool) -> DataFrame:
    """The rows of each group's bucket of ``_bounds``: one row in 256 of a large group."""
    b = F.broadcast(bounds) if small else bounds
    return _join_null_safe(narrow.withColumnRenamed("_b1", "_bk"), b.withColumnRenamed("_b1", "_bk"), [*g, "_bk"], "inner") \
        .drop("_bk")


def prefix_select(df: DataFrame, order_hex: Column, tiebreak: Column, limit,
                  group_cols=None, weight: Column | None = None,
                  out: str = "selected") -> DataFrame:
    """Flag the rows that come first in hash order until a weight limit.

    A row is selected iff the total weight of the rows before it in its
    group (ordered by ``order_hex`` then ``tiebreak``) is ``< limit``.  With
    unit weights and an integer limit ``q`` that is ``rank <= q``; with
    weights it is "take items until the running total reaches the limit,
    the crossing item included".

    ``limit`` is a number, a DataFrame of ``group_cols + [limit]``, or a
    function that makes one of the table ``group_cols + [total]`` of the
    groups' total weights.

    Radix selection: a histogram of the key's first digits says in which
    bucket of a group the limit is passed (computed when this is called, one
    row a group); only the narrow rows of that bucket, one in 256, are
    shuffled and ranked; the last selected key of each group is compared with
    every row.  Up to ``BROADCAST_GROUPS`` groups (counted) their bounds are
    broadcast, so that no other row, narrow or wide, is shuffled; of more
    groups, which are then small, rows and bounds are joined by a shuffle.
    """
    g = _cols(group_cols)
    d = df
    if not g:
        d = d.withColumn("_g0", F.lit(0))  # one implicit group
        g = ["_g0"]
        if isinstance(limit, DataFrame):
            limit = limit.withColumn("_g0", F.lit(0))
    ensure_checkpoint_dir(df.sparkSession)
    d = d.withColumn("_rank", F.struct(order_hex.alias("k"), tiebreak.alias("t")))
    narrow = d.select(*g, "_rank", hash_bucket(F.col("_rank.k"), RADIX_DIGITS).alias("_b1"),
                      (weight if weight is not None else F.lit(1)).cast("long").alias("_w"))
    bounds = _bounds(narrow, g, limit).checkpoint()
    small = bounds.count() <= BROADCAST_GROUPS
    edge = _edge_rows(narrow, bounds, g, small).withColumn(
        "_bk", F.substring("_rank.k", RADIX_DIGITS + 1, 4))
    win = Window.partitionBy(*g, "_bk").orderBy("_rank").rowsBetween(UNBOUNDED, 0)
    local = edge.withColumn("_loc", F.sum("_w").over(win))
    offs = _bucket_offsets(local, g, "_bk", "_w").select(*g, "_bk", "_boff")
    ranked = _join_null_safe(local, offs, [*g, "_bk"], "inner")
    last = (ranked.where(F.col("_before") + F.col("_boff") + F.col("_loc") - F.col("_w") < F.col("_limit"))
            .groupBy(*g).agg(F.max("_rank").alias("_last")))
    joined = _join_null_safe(d, F.broadcast(last) if small else last, g, "left")
    return joined.withColumn(out, F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False))) \
        .drop("_rank", "_last", "_g0")


def hash_rank_select(df: DataFrame, seed, key_col: str, limit, group_cols=None,
                     out: str = "selected") -> DataFrame:
    """Rows whose rank in ``md5(seed:key)`` order within the group is <= limit."""
    from residuum.functions.hashing import rank_key
    return prefix_select(df, rank_key(seed, key_col), F.col(key_col), limit,
                         group_cols, None, out)
