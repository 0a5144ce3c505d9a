"""Sequence-search queries: candidates are the first record of each class;
targets are the mean encoder vector of the class (both read whole tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from residuum.functions.residues import AMINO_ACIDS
from residuum.operators import embed, evolve
from residuum.operators.metrics import population_stats
from residuum.plans.registry import query
from residuum.sources.testbed import REC_SQL, records

SEED = 42
NGEN = 6


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def mutated(spark, sf):
    r = records(spark, sf).select("record_id", "seq")
    return r.withColumn("mut", evolve.point_mutate(F.col("seq"), F.col("record_id"), SEED, 50))


def n_changed(a, b):
    z = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.size(F.filter(z, lambda p: p["x"] != p["y"]))


def _mut_sql(seed, key, step=50, src="seq"):
    return (f"CASE WHEN length({src}) = 0 THEN {src} ELSE array_to_string(list_transform(string_split({src}, ''), "
            f"lambda c, i: CASE WHEN (i - 1) % {step} = 0 THEN substring('{AMINO_ACIDS}', "
            f"CAST(CAST(('0x' || substring(md5(concat('{seed}', ':', {key}, ':', i - 1)), 1, 8)) AS BIGINT) % 20 AS INTEGER) + 1, 1) "
            f"ELSE c END), '') END")


MUT_SQL = REC_SQL + f""",
mt AS (SELECT record_id, seq, {_mut_sql(SEED, 'record_id')} AS mut FROM rec)"""


@query("point_mutate", f"""WITH {MUT_SQL}
SELECT record_id, md5(mut) AS mut_md5,
       len(list_filter(range(1, length(seq) + 1), lambda i: substring(seq, i, 1) <> substring(mut, i, 1))) AS n_changed
FROM mt""")
def q_point_mutate(spark, sf):
    m = mutated(spark, sf)
    return m.select("record_id", F.md5("mut").alias("mut_md5"),
                    n_changed(F.col("seq"), F.col("mut")).cast("long").alias("n_changed"))


@query("edit_distance", f"""WITH {MUT_SQL}
SELECT record_id, levenshtein(seq, mut) AS distance FROM mt""")
def q_edit_distance(spark, sf):
    m = mutated(spark, sf).withColumn("bound", n_changed(F.col("seq"), F.col("mut")))
    # substitutions only, so their count bounds the distance: banded, exact
    return m.select("record_id", evolve.edit_distance(F.col("seq"), F.col("mut"), F.col("bound"))
                    .cast("long").alias("distance"))


@query("compose_sequence", f"""WITH {REC_SQL}
SELECT record_id, md5(reverse(seq)) AS seq_md5 FROM rec""")
def q_compose_sequence(spark, sf):
    """Characters in reverse order, composed."""
    r = records(spark, sf)
    back = evolve.compose_sequence(F.reverse(F.split("seq", "")))
    return r.select("record_id", F.md5(back).alias("seq_md5"))


def candidates(spark, sf):
    r = records(spark, sf).select("class", "record_pos", "record_id", "seq")
    # the first positions from narrow rows; only their records carry a sequence
    least = r.groupBy("class").agg(F.min("record_pos").alias("_p")).withColumnRenamed("class", "_c")
    mine = F.broadcast(least).join(r, F.col("_c").eqNullSafe(F.col("class")) & (F.col("_p") == F.col("record_pos")), "inner")
    first = mine.groupBy("_c").agg(F.min_by(F.struct("record_id", "seq"), "record_pos").alias("r"))
    every = least.join(first.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d")), "left")
    return every.select(F.col("r.record_id").alias("candidate_id"), "r.seq", F.col("_c").alias("class"))


def targets(spark, sf, cands):
    prof = embed.embed_sequences(records(spark, sf).select("class", "seq"))
    t = evolve.class_targets(prof, "class").withColumnRenamed("candidate_id", "class")
    return cands.select("candidate_id", "class").join(t, "class").select("candidate_id", "target")


CAND_SQL = REC_SQL + f""",
cand AS (SELECT record_id AS candidate_id, seq FROM (
           SELECT *, row_number() OVER (PARTITION BY class ORDER BY record_pos) AS rn FROM rec) WHERE rn = 1),
st AS (SELECT candidate_id, {_mut_sql(str(SEED) + '-start', 'candidate_id')} AS seq FROM cand)"""


@query("seed_population", f"""WITH {CAND_SQL}
SELECT candidate_id, CAST(i AS INTEGER) AS individual_id, md5(seq) AS seq_md5 FROM st, unnest(range(0, 50)) AS t(i)""")
def q_seed_population(spark, sf):
    p = evolve.seed_population(candidates(spark, sf), 50, f"{SEED}-start", 50)
    return p.select("candidate_id", "individual_id", F.md5("seq").alias("seq_md5"))


def _evaluated_start(spark, sf):
    c = candidates(spark, sf)
    t = targets(spark, sf, c)
    pop = evolve.evaluate(evolve.seed_population(c, 50, f"{SEED}-start", 50), t)
    return c, t, pop


def _profile_sql(src, key):
    """Hashed 3-mer profile (64 dims, zeros included) of ``src(key, seq)``."""
    return f"""(SELECT {key}, d AS bucket, coalesce(v, 0.0) AS value FROM
  (SELECT DISTINCT {key} FROM {src}) ids CROSS JOIN range(0, 64) AS r(d)
  LEFT JOIN (SELECT {key} AS k2, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM
              (SELECT {key}, CAST(('0x' || substring(md5(substring(seq, p, 3)), 1, 8)) AS BIGINT) % 64 AS bucket,
                      count(*) AS n
               FROM {src}, unnest(range(1, length(seq) - 1)) AS t(p) GROUP BY 1, 2)) c
  ON c.k2 = ids.{key} AND c.bucket = r.d)"""


FIT_SQL = f"""{CAND_SQL},
cls AS (SELECT candidate_id, class FROM (
          SELECT record_id AS candidate_id, class, row_number() OVER (PARTITION BY class ORDER BY record_pos) AS rn
          FROM rec) WHERE rn = 1),
prof AS {_profile_sql('rec', 'record_id')},
cen AS (SELECT r.class, p.bucket, sum(p.value) / count(*) AS t FROM prof p JOIN rec r USING (record_id)
        GROUP BY 1, 2),
pp AS {_profile_sql('st', 'candidate_id')},
y AS (SELECT pp.candidate_id, pp.bucket, pp.value AS y, cen.t FROM pp JOIN cls USING (candidate_id)
      JOIN cen ON cen.class = cls.class AND cen.bucket = pp.bucket),
r2 AS (SELECT candidate_id, 1 - sum((y - t) ^ 2) / sum((y - m) ^ 2) AS f FROM
         (SELECT *, avg(y) OVER (PARTITION BY candidate_id) AS m FROM y) GROUP BY 1)"""


@query("fitness", f"""WITH {FIT_SQL}
SELECT candidate_id, CAST(i AS INTEGER) AS individual_id, round(f, 6) AS fitness
FROM r2, unnest(range(0, 50)) AS t(i)""")
def q_fitness(spark, sf):
    _, _, pop = _evaluated_start(spark, sf)
    return pop.select("candidate_id", "individual_id", r6(F.col("fitness")).alias("fitness"))


@query("population_stats", f"""WITH {FIT_SQL}
SELECT 0 AS generation, candidate_id, round(f, 6) AS avg, round(f, 6) AS min, round(f, 6) AS max FROM r2""")
def q_population_stats(spark, sf):
    _, _, pop = _evaluated_start(spark, sf)
    s = population_stats(pop.withColumn("generation", F.lit(0)))
    return s.select("generation", "candidate_id", *[r6(F.col(c)).alias(c) for c in ("avg", "min", "max")])


MUTPOP_SQL = f"""{FIT_SQL},
mut AS (SELECT candidate_id, ind, concat(candidate_id, '/', ind) AS k,
               {_mut_sql(SEED, "concat('0', ':', candidate_id, ':', ind)")} AS seq
        FROM st, unnest(range(0, 50)) AS t(ind)),
mp AS {_profile_sql('mut', 'k')},
my AS (SELECT mut.candidate_id, mut.ind, mut.k, mp.bucket, mp.value AS y, cen.t FROM mp JOIN mut USING (k)
       JOIN cls USING (candidate_id) JOIN cen ON cen.class = cls.class AND cen.bucket = mp.bucket),
mf AS (SELECT candidate_id, ind, 1 - sum((y - t) ^ 2) / sum((y - m) ^ 2) AS f FROM
         (SELECT *, avg(y) OVER (PARTITION BY k) AS m FROM my) GROUP BY 1, 2)"""


def _mutated_population(spark, sf, c=None, t=None):
    """Generation 0 with every individual mutated apart, and its own fitness."""
    c = candidates(spark, sf).checkpoint() if c is None else c
    pop = evolve.mutate_population(evolve.seed_population(c, 50, f"{SEED}-start", 50), SEED, 0, 1.0)
    return evolve.evaluate(pop, targets(spark, sf, c) if t is None else t).checkpoint()


@query("tournament_select", f"""WITH {MUTPOP_SQL},
dr AS (SELECT candidate_id, slot, draw,
              CAST(('0x' || substring(md5(concat('42', ':', '1', ':', candidate_id, ':', slot, ':', draw)), 1, 8))
                   AS BIGINT) % 50 AS ind
       FROM cls, unnest(range(0, 50)) AS t(slot), unnest(range(0, 3)) AS u(draw)),
won AS (SELECT dr.*, mf.f, row_number() OVER (PARTITION BY candidate_id, slot ORDER BY round(mf.f, 9) DESC, draw) AS rn
        FROM dr JOIN mf USING (candidate_id, ind))
SELECT won.candidate_id, CAST(slot AS INTEGER) AS individual_id, md5(mut.seq) AS seq_md5, round(won.f, 6) AS fitness
FROM won JOIN mut USING (candidate_id, ind) WHERE rn = 1""")
def q_tournament_select(spark, sf):
    # fitness to 9 places, so that engines agree on what a tie is
    pop = _mutated_population(spark, sf).withColumn("fitness", F.round("fitness", 9))
    sel = evolve.tournament_select(pop, 50, SEED, 1)
    return sel.select("candidate_id", "individual_id", F.md5("seq").alias("seq_md5"),
                      r6(F.col("fitness")).alias("fitness"))


@query("uniform_crossover", f"""WITH {CAND_SQL},
pop AS (SELECT candidate_id, ind AS individual_id,
               {_mut_sql(SEED, "concat('0', ':', candidate_id, ':', ind)")} AS seq
        FROM st, unnest(range(0, 50)) AS t(ind)),
pr AS (SELECT candidate_id, individual_id // 2 AS pair,
              max(CASE WHEN individual_id % 2 = 0 THEN seq END) AS a,
              max(CASE WHEN individual_id % 2 = 1 THEN seq END) AS b FROM pop GROUP BY 1, 2),
m AS (SELECT *, b IS NOT NULL AND CAST(('0x' || substring(md5(concat('42', ':', '1', ':', candidate_id, ':', pair)), 1, 8))
                AS BIGINT) / 4294967296.0 < 0.5 AS mate FROM pr),
kids AS (SELECT candidate_id, pair * 2 AS individual_id,
                CASE WHEN mate THEN array_to_string(list_transform(string_split(a, ''), lambda c, i: CASE WHEN md5(concat('42-x', ':', '1', ':', candidate_id, ':', pair, ':', i)) < '1999999a' THEN substring(b, i, 1) ELSE c END), '') ELSE a END AS seq FROM m
         UNION ALL
         SELECT candidate_id, pair * 2 + 1, CASE WHEN mate THEN array_to_string(list_transform(string_split(b, ''), lambda c, i: CASE WHEN md5(concat('42-x', ':', '1', ':', candidate_id, ':', pair, ':', i)) < '1999999a' THEN substring(a, i, 1) ELSE c END), '') ELSE b END FROM m)
SELECT candidate_id, individual_id, md5(seq) AS seq_md5, length(seq) AS seq_len FROM kids WHERE seq IS NOT NULL""")
def q_uniform_crossover(spark, sf):
    c = candidates(spark, sf)
    pop = evolve.mutate_population(evolve.seed_population(c, 50, f"{SEED}-start", 50), SEED, 0, 1.0)
    kids = evolve.uniform_crossover(pop, SEED, 1)
    return kids.select("candidate_id", "individual_id", F.md5("seq").alias("seq_md5"),
                       F.length("seq").cast("long").alias("seq_len"))


@query("mutate_population", f"""WITH {CAND_SQL},
pop AS (SELECT candidate_id, CAST(i AS INTEGER) AS individual_id, seq FROM st, unnest(range(0, 50)) AS t(i)),
hit AS (SELECT *, CAST(('0x' || substring(md5(concat('42-m', ':', '1', ':', candidate_id, ':', individual_id)), 1, 8))
                  AS BIGINT) / 4294967296.0 < 0.2 AS h,
               concat('1', ':', candidate_id, ':', individual_id) AS k FROM pop)
SELECT candidate_id, individual_id,
       md5(CASE WHEN h THEN {_mut_sql(SEED, 'k')} ELSE seq END) AS seq_md5 FROM hit""")
def q_mutate_population(spark, sf):
    c = candidates(spark, sf)
    pop = evolve.mutate_population(evolve.seed_population(c, 50, f"{SEED}-start", 50), SEED, 1)
    return pop.select("candidate_id", "individual_id", F.md5("seq").alias("seq_md5"))


def _run(spark, sf):
    c = candidates(spark, sf).checkpoint()
    t = targets(spark, sf, c).checkpoint()
    pop, log, best = evolve.run_generations(c, t, NGEN, 50, SEED)
    return c, t, pop, log, best


@query("run_generations", f"""WITH {FIT_SQL}
SELECT candidate_id, {NGEN + 1} AS n_generations, round(f, 6) AS start_best, 50 AS n_individuals,
       0 AS n_wrong_length, true AS ordered FROM r2""")
def q_run_generations(spark, sf):
    """The log against what SQL knows: generations, the start's fitness, sizes."""
    c, _, pop, log, _ = _run(spark, sf)
    sizes = pop.join(c.select("candidate_id", F.length("seq").alias("n")), "candidate_id").groupBy("candidate_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_individuals"),
        F.sum((F.length("seq") != F.col("n")).cast("int")).cast("int").alias("n_wrong_length"))
    per = log.groupBy("candidate_id").agg(
        F.countDistinct("generation").cast("int").alias("n_generations"),
        r6(F.max(F.when(F.col("generation") == 0, F.col("max")))).alias("start_best"),
        F.bool_and((F.col("min") <= F.col("avg") + 1e-12) & (F.col("avg") <= F.col("max") + 1e-12)).alias("ordered"))
    return per.join(sizes, "candidate_id")


@query("hall_of_fame", f"""WITH {MUTPOP_SQL},
top AS (SELECT candidate_id, md5(mut.seq) AS seq_md5, round(mf.f, 9) AS f,
               row_number() OVER (PARTITION BY candidate_id ORDER BY round(mf.f, 9) DESC, mut.seq) AS rn
        FROM mf JOIN mut USING (candidate_id, ind))
SELECT candidate_id, seq_md5, round(f, 6) AS fitness, true AS never_falls FROM top WHERE rn = 1""")
def q_hall_of_fame(spark, sf):
    """Best of a whole mutated generation, and that the run's best never falls
    below any generation's."""
    c, t, _, log, best = _run(spark, sf)
    pop = _mutated_population(spark, sf, c, t).withColumn("fitness", F.round("fitness", 9))
    kept = log.groupBy("candidate_id").agg(F.max("max").alias("m")).join(best, "candidate_id") \
        .select("candidate_id", (F.col("fitness") >= F.col("m") - 1e-12).alias("never_falls"))
    top = evolve.hall_of_fame(pop).select("candidate_id", F.md5("seq").alias("seq_md5"),
                                          r6(F.col("fitness")).alias("fitness"))
    return top.join(kept, "candidate_id")


@query("distance_report", f"""WITH {MUTPOP_SQL},
top AS (SELECT candidate_id, mut.seq, row_number() OVER (PARTITION BY candidate_id ORDER BY round(mf.f, 9) DESC, mut.seq) AS rn
        FROM mf JOIN mut USING (candidate_id, ind))
SELECT cand.candidate_id, levenshtein(cand.seq, st.seq) AS dist_original_start,
       levenshtein(cand.seq, top.seq) AS dist_original_best, true AS within_length
FROM cand JOIN st USING (candidate_id) JOIN top USING (candidate_id) WHERE rn = 1""")
def q_distance_report(spark, sf):
    """Distances of the start and of the best of one mutated generation, and that the
    best of the whole run is no farther from the original than its length."""
    c, t, _, _, best = _run(spark, sf)
    start = evolve.seed_population(c, 1, f"{SEED}-start", 50)
    run = evolve.distance_report(c, start, best).join(c.select("candidate_id", F.length("seq").alias("n")), "candidate_id") \
        .select("candidate_id", F.col("dist_original_best").between(0, F.col("n")).alias("within_length"))
    top = evolve.hall_of_fame(_mutated_population(spark, sf, c, t).withColumn("fitness", F.round("fitness", 9)))
    rep = evolve.distance_report(c, start, top)
    return rep.select("candidate_id", *[F.col(d).cast("long").alias(d) for d in ("dist_original_start", "dist_original_best")]) \
        .join(run, "candidate_id")
