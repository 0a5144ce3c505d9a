"""Sequence search toward a target vector, as DataFrame operations.

A population is ``(candidate_id, individual_id, seq[, fitness])``; every
step (selection, crossover, mutation, scoring) is one Spark plan over all
candidates' populations at once.  Every random draw is a digest of
``seed:generation:candidate:...``, so a run is reproducible.  The driver
only advances generations, appends the per-generation log and checkpoints
(reliable checkpoint, shared folder) every few generations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.hashing import draw_int, draw_unit, rank_key
from residuum.functions.residues import aa_array
from residuum.operators.embed import kmer_profile
from residuum.session import scratch_path
from residuum.operators.metrics import population_stats, row_cosine, row_r2

# digest prefix below which an event has probability 0.1
P10 = "1999999a"

# widths of the bands that ``edit_distance`` tries in turn
BANDS = (8, 32, 128, 512, 2048, 8192)


def point_mutate(seq: Column, key: Column, seed, step: int = 50,
                 max_pos: int | None = None) -> Column:
    """PRJ20: redraw the residue at positions 0, step, 2*step, ... (below
    ``max_pos`` if given) uniformly from the 20 amino acids (the old one may
    be drawn again)."""
    aa = aa_array()

    def at(c, i):  # noqa: E306
        hit = (i % F.lit(step)) == 0
        if max_pos is not None:
            hit = hit & (i < F.lit(max_pos))
        return F.when(hit, F.element_at(aa, (draw_int(seed, 20, key, i) + 1).cast("int"))).otherwise(c)
    return F.when(F.length(seq) > 0, F.array_join(F.transform(F.split(seq, ""), at), "")) \
            .otherwise(seq)


def edit_distance(a: Column, b: Column, bound: Column | None = None) -> Column:
    """PRJ21: Levenshtein distance.  With ``bound`` (any known upper bound,
    e.g. the number of substituted positions) the computation is banded and
    still exact.  Where ``substitutions_only`` proves the distance, nothing is
    aligned at all.  Without a bound the band is widened (8, 32, 128, ...) until the
    distance lies in it, so two sequences of length n at distance d cost
    about n * d steps and not n * n; only distances beyond the widest band
    take the plain computation."""
    known = substitutions_only(a, b)
    if bound is not None:
        plain = F.call_function("levenshtein", a, b, bound.cast("int"))
        return F.when(known.isNotNull() & (bound >= 0), F.when(known <= bound, known).otherwise(F.lit(-1))).otherwise(plain)
    widened = [F.nullif(F.call_function("levenshtein", a, b, F.lit(w)), F.lit(-1)) for w in BANDS]
    return F.coalesce(known, *widened, F.levenshtein(a, b))


def substitutions_only(a: Column, b: Column) -> Column:
    """The edit distance of two texts of one length where it is proved to be their number
    of differing places, else null.  The proof cuts ``a`` into one piece per difference:
    each edit lies in at most one piece, and a piece that ``b`` holds nowhere near needs
    one, so as many edits are needed as there are pieces.  Near: ``h`` edits that end at
    the same length leave the diagonal by at most ``h / 2``."""

    @F.pandas_udf("int")
    def _proved(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_substitutions(x, y) for x, y in zip(xs, ys)], dtype="Int32")

    return _proved.asNondeterministic()(a, b)


def _substitutions(a: str | None, b: str | None) -> int | None:
    if a is None or b is None or len(a) != len(b):
        return None
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (a, b))
    at = np.flatnonzero(x != y)
    h, near = len(at), len(at) // 2
    cuts = [0, *((at[1:] + at[:-1] + 1) // 2).tolist(), len(a)]
    for lo, hi in zip(cuts[:-1], cuts[1:]) if h else ():
        if b.find(a[lo:hi], max(0, lo - near), hi + near) >= 0:
            return None
    return h


def compose_sequence(chars: Column) -> Column:
    """PRJ22: character list -> sequence (``split(s, '')`` is the inverse)."""
    return F.array_join(chars, "")


def seed_population(candidates: DataFrame, n: int = 50, seed="start", step: int = 50,
                    id_col: str = "candidate_id", seq_col: str = "seq") -> DataFrame:
    """GEN1: ``n`` identical copies of each candidate after one PRJ20 pass."""
    start = point_mutate(F.col(seq_col), F.col(id_col), seed, step)
    return candidates.select(F.col(id_col).alias("candidate_id"), start.alias("seq"),
                             F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("individual_id"))


def class_targets(profiles: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Target vector per group: the mean encoder vector of its records (a
    partial aggregate per dimension)."""
    e = profiles.select(group_col, F.posexplode(vec_col).alias("dim", "v"))
    m = e.groupBy(group_col, "dim").agg(F.avg("v").alias("v"))
    return m.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_s")) \
            .select(F.col(group_col).alias("candidate_id"),
                    F.transform("_s", lambda x: x["v"]).alias("target"))


def evaluate(pop: DataFrame, targets: DataFrame, encoder=kmer_profile, measure: str = "r2") -> DataFrame:
    """GEN5: fitness of every row of ``pop`` (``candidate_id``, ``seq`` and any other
    columns) = R^2 between the encoded individual and its candidate's target,
    prediction passed as truth (the source's argument order), or with
    ``measure='cosine'`` their cosine."""
    if measure not in ("r2", "cosine"):
        raise ValueError(f"unknown measure {measure!r}")
    t = targets.select("candidate_id", "target")
    j = pop.join(t, "candidate_id")
    # the encoder (a Python UDF) is its own column; the lambdas read it
    j = j.withColumn("_pred", encoder(F.col("seq")))
    found = row_r2(F.col("_pred"), F.col("target"), "pred") if measure == "r2" \
        else row_cosine(F.col("_pred"), F.col("target"))
    return j.withColumn("fitness", found).drop("target", "_pred")


class FitnessMemo:
    """Fitness of every (candidate, sequence) that was ever encoded, as a table of
    (candidate_id, digest, fitness), one folder a generation.

    A generation's individuals are joined with the table by an anti-join; only the
    distinct sequences that it lacks are encoded.  Selection copies the fittest and
    mating leaves half of the pairs alone, so most of a generation is known.  A
    generation that is computed again replaces its folder."""

    def __init__(self, targets: DataFrame, path: str, encoder=kmer_profile, measure: str = "r2"):
        self.spark, self.targets, self.path = targets.sparkSession, targets, path
        self.encoder, self.measure, self.generations = encoder, measure, 0

    def known(self) -> DataFrame:
        return self.spark.read.schema("candidate_id string, digest string, fitness double") \
            .option("recursiveFileLookup", "true").parquet(self.path)

    def evaluate(self, pop: DataFrame, generation: int) -> DataFrame:
        """``pop`` (candidate_id, individual_id, seq) with its fitness; ``pop`` is read
        twice and should be materialised."""
        keyed = pop.select(F.col("candidate_id"), "individual_id", "seq", F.sha2("seq", 256).alias("digest"))
        unseen = keyed.groupBy("candidate_id", "digest").agg(F.first("seq").alias("seq"))
        if generation:
            unseen = unseen.join(self.known().select(F.col("candidate_id").alias("_c"), F.col("digest").alias("_d")),
                                 (F.col("candidate_id").cast("string") == F.col("_c")) & (F.col("digest") == F.col("_d")), "left_anti")
        evaluate(unseen, self.targets, self.encoder, self.measure) \
            .select(F.col("candidate_id").cast("string").alias("candidate_id"), "digest", "fitness") \
            .write.mode("overwrite").parquet(f"{self.path}/generation={generation}")
        known = self.known().select(F.col("candidate_id").alias("_c"), F.col("digest").alias("_d"), "fitness")
        return keyed.join(known, (F.col("candidate_id").cast("string") == F.col("_c")) & (F.col("digest") == F.col("_d"))) \
            .select("candidate_id", "individual_id", "seq", "fitness")


def tournament_select(pop: DataFrame, n: int, seed, gen: int, size: int = 3) -> DataFrame:
    """GEN2: for each of ``n`` slots draw ``size`` individuals with
    replacement and keep the fittest (the earliest drawn on ties)."""
    slots = pop.select("candidate_id").distinct().select(
        "candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    draws = slots.select("candidate_id", "slot",
                         F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("m"))
    draws = draws.withColumn("individual_id",
                             draw_int(seed, n, F.lit(gen), "candidate_id", "slot", "m").cast("int"))
    j = draws.join(pop.select("candidate_id", "individual_id", "seq", "fitness"),
                   ["candidate_id", "individual_id"])
    best = j.groupBy("candidate_id", "slot").agg(
        F.max_by("seq", F.struct("fitness", (-F.col("m")).alias("first"))).alias("seq"),
        F.max("fitness").alias("fitness"))
    return best.select("candidate_id", F.col("slot").alias("individual_id"), "seq", "fitness")


def uniform_crossover(pop: DataFrame, seed, gen: int, cxpb: float = 0.5,
                      swap_prefix: str = P10) -> DataFrame:
    """GEN3: neighbours (0,1), (2,3), ... mate with probability ``cxpb``;
    mating swaps each position with probability 0.1.  An odd last
    individual is left as it is."""
    p = pop.withColumn("pair", F.floor(F.col("individual_id") / 2))
    pairs = p.groupBy("candidate_id", "pair").agg(
        F.max(F.when(F.col("individual_id") % 2 == 0, F.col("seq"))).alias("a"),
        F.max(F.when(F.col("individual_id") % 2 == 1, F.col("seq"))).alias("b"))
    mate = (draw_unit(seed, F.lit(gen), "candidate_id", "pair") < F.lit(cxpb)) & F.col("b").isNotNull()
    pairs = pairs.withColumn("_mate", mate).withColumn("_ca", F.split("a", "")).withColumn(
        "_cb", F.split("b", ""))

    def child(x, y):
        return F.array_join(F.transform(
            F.sequence(F.lit(1), F.size(x)),
            lambda i: F.when(rank_key(f"{seed}-x", F.lit(gen), F.col("candidate_id"), F.col("pair"), i)
                             < F.lit(swap_prefix), F.element_at(y, i)).otherwise(F.element_at(x, i))),
            "")
    c1 = F.when(F.col("_mate"), child(F.col("_ca"), F.col("_cb"))).otherwise(F.col("a"))
    c2 = F.when(F.col("_mate"), child(F.col("_cb"), F.col("_ca"))).otherwise(F.col("b"))
    out = pairs.select("candidate_id", F.explode(F.array(
        F.struct((F.col("pair") * 2).alias("individual_id"), c1.alias("seq")),
        F.struct((F.col("pair") * 2 + 1).alias("individual_id"), c2.alias("seq")))).alias("_k"))
    return out.select("candidate_id", "_k.*").where(F.col("seq").isNotNull())


def mutate_population(pop: DataFrame, seed, gen: int, mutpb: float = 0.2, step: int = 50
                      ) -> DataFrame:
    """GEN4: with probability ``mutpb`` an individual is redrawn at all
    listed positions (PRJ20)."""
    key = F.concat_ws(":", F.lit(gen).cast("string"), F.col("candidate_id").cast("string"),
                      F.col("individual_id").cast("string"))
    hit = draw_unit(f"{seed}-m", F.lit(gen), "candidate_id", "individual_id") < F.lit(mutpb)
    return pop.withColumn("seq", F.when(hit, point_mutate(F.col("seq"), key, seed, step))
                          .otherwise(F.col("seq")))


def hall_of_fame(pop: DataFrame, k: int = 1) -> DataFrame:
    """TOP1: best ``k`` distinct sequences per candidate (fitness, then
    sequence).  Groups are one candidate's individuals, bounded by the
    population size."""
    from pyspark.sql import Window
    d = pop.groupBy("candidate_id", "seq").agg(F.max("fitness").alias("fitness"))
    w = Window.partitionBy("candidate_id").orderBy(F.desc("fitness"), "seq")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _materialise(df: DataFrame, reliable: bool) -> DataFrame:
    """Compute a generation once: a reliable checkpoint (shared folder, cuts
    the lineage, survives lost executors) or a persisted copy (recomputed
    from the last checkpoint if blocks are lost)."""
    if reliable:
        return df.checkpoint()
    df = df.persist()
    df.count()
    return df


def run_generations(candidates: DataFrame, targets: DataFrame, ngen: int, n: int = 50,
                    seed=42, cxpb: float = 0.5, mutpb: float = 0.2, step: int = 50,
                    checkpoint_every: int = 4, log_path: str | None = None, encoder=kmer_profile,
                    measure: str = "r2", memo_path: str | None = None):
    """GEN6: select -> mate -> mutate -> evaluate, ``ngen`` times.

    Returns (final population, generation log, best-ever per candidate).
    Only individuals whose sequence is new to their candidate are encoded
    (``FitnessMemo``, a table at ``memo_path`` or in the scratch folder).  Each generation is computed once (persisted), and every
    ``checkpoint_every`` generations reliably checkpointed, and the log is
    appended to a table per generation (``log_path``, or a scratch table), so
    plans stay of one size however many generations run.
    """
    spark = candidates.sparkSession
    log_path = log_path or scratch_path(spark, "generations")
    targets = targets.select("candidate_id", "target").checkpoint()  # one row per candidate
    memo = FitnessMemo(targets, memo_path or scratch_path(spark, "fitness"), encoder, measure)
    pop = memo.evaluate(seed_population(candidates, n, f"{seed}-start", step).checkpoint(), 0)
    pop = _materialise(pop, True)
    best = _materialise(hall_of_fame(pop), True)
    population_stats(pop.withColumn("generation", F.lit(0))).write.mode("append").parquet(log_path)
    for g in range(1, ngen + 1):
        sel = tournament_select(pop, n, seed, g)
        kids = uniform_crossover(sel.drop("fitness"), seed, g, cxpb)
        kids = mutate_population(kids, seed, g, mutpb, step)
        reliable = g % checkpoint_every == 0 or g == ngen
        old_pop, old_best = pop, best
        kids = _materialise(kids, False)
        pop = _materialise(memo.evaluate(kids, g), reliable)
        best = _materialise(
            hall_of_fame(best.unionByName(pop.select("candidate_id", "seq", "fitness"))), reliable)
        for old in (old_pop, old_best, kids):
            old.unpersist()
        stats = population_stats(pop.withColumn("generation", F.lit(g)))
        stats.write.mode("append").parquet(log_path)
    log = spark.read.parquet(log_path)
    return pop, log, best


def distance_report(original: DataFrame, start: DataFrame, best: DataFrame) -> DataFrame:
    """GEN7: edit distance original -> best and original -> start."""
    o = original.select("candidate_id", F.col("seq").alias("original"))
    s = start.select("candidate_id", F.col("seq").alias("start")).dropDuplicates(["candidate_id"])
    b = best.select("candidate_id", F.col("seq").alias("best"), "fitness")
    j = o.join(s, "candidate_id").join(b, "candidate_id")
    return j.select("candidate_id", "fitness",
                    edit_distance(F.col("original"), F.col("best")).alias("dist_original_best"),
                    edit_distance(F.col("original"), F.col("start")).alias("dist_original_start"))
