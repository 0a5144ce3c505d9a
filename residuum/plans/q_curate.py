"""Curation queries: dedupe, splits, chunks, weights, id/family routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.operators import balance, curate, split
from residuum.operators.chunk import chunk_sequence
from residuum.plans.registry import query
from residuum.session import scratch_path
from residuum.sources.testbed import CLASS_ORDER, CLASS_RANK_SQL, REC_SQL, records

SEED = 42

# SQL fragments shared by several oracles -------------------------------------

QUOTA_SQL = """cc AS (SELECT coalesce(class, chr(0) || 'null') AS sk, count(*) AS c FROM {src} GROUP BY 1),
q1 AS (SELECT sk, c, sum(c) OVER () AS n FROM cc),
q2 AS (SELECT *, CAST(ceil(n * {frac}) AS BIGINT) AS n_test FROM q1),
q3 AS (SELECT *, (n - n_test) * c // n AS f, (n - n_test) * c % n AS r, n - n_test AS n_train FROM q2),
q4 AS (SELECT *, n_train - sum(f) OVER () AS need,
              row_number() OVER (ORDER BY r DESC, sk) AS rk FROM q3),
quota AS (SELECT sk, c - (f + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS quota FROM q4)"""

STRAT_SQL = REC_SQL + ",\n" + QUOTA_SQL.format(src="rec", frac="0.1") + """,
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY coalesce(class, chr(0) || 'null')
                 ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn FROM rec r),
strat AS (SELECT ranked.*, CASE WHEN rn <= quota THEN 'validation' ELSE 'train' END AS split
          FROM ranked JOIN quota ON coalesce(class, chr(0) || 'null') = quota.sk)"""

DEDUP_SQL = REC_SQL + f""",
dd AS (SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY seq ORDER BY {CLASS_RANK_SQL}, record_pos) AS rn
         FROM rec) WHERE rn = 1)"""

DEDUP_STRAT_SQL = DEDUP_SQL + ",\n" + QUOTA_SQL.format(src="dd", frac="0.1") + """,
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY coalesce(class, chr(0) || 'null')
                 ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn FROM dd r),
strat AS (SELECT ranked.*, CASE WHEN rn <= quota THEN 'validation' ELSE 'train' END AS split
          FROM ranked JOIN quota ON coalesce(class, chr(0) || 'null') = quota.sk)"""

FAMILY_CTES = """fam AS (SELECT family, count(*) AS n_rows FROM rec WHERE family IS NOT NULL GROUP BY family),
tot AS (SELECT count(*) AS total FROM rec),
ord AS (SELECT family, n_rows,
               CAST(sum(n_rows) OVER (ORDER BY md5(concat('42', ':', family)), family
                                      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_rows,
               row_number() OVER (ORDER BY md5(concat('42', ':', family)), family) AS cum_families
        FROM fam),
testf AS (SELECT ord.* FROM ord, tot WHERE cum_rows - n_rows < total * 0.2)"""
FAMILY_SQL = REC_SQL + ",\n" + FAMILY_CTES


def deduped(spark, sf):
    """First record of each sequence with the sequence's length and md5; the
    sequences themselves do not move."""
    r = records(spark, sf).withColumn("seq_len", F.length("seq").cast("long")).withColumn("seq_md5", F.md5("seq"))
    return curate.dedupe_by_sequence(r, CLASS_ORDER, keep=["record_id", "class", "seq_len", "seq_md5"], with_seq=False)


# ------------------------------------------------------------------ flagship


def training_set_summary(spark, sf, size: int = 512):
    """Minimum slice: dedupe -> stratified 90/10 split of records -> chunks
    of 512 -> per class and split: records, chunks, residues, and balanced
    class weights over the training chunks.  A summary needs the lengths of the
    chunked sequences only, so the rows that move are narrow, and the weights
    come from the same aggregate."""
    sp = split.stratified_split(deduped(spark, sf).select("record_id", "class", "seq_len"), "class", 0.1, SEED)
    per = sp.where(F.col("seq_len") > 0).groupBy("class", "split").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.ceil(F.col("seq_len") / F.lit(float(size)))).cast("long").alias("n_chunks"),
        F.sum("seq_len").cast("long").alias("n_residues"))
    # one row per class and split from here on
    train = F.when(F.col("split") == "train", F.col("n_chunks"))
    every, own = Window.partitionBy(), Window.partitionBy("class")
    weight = F.sum(train).over(every) / (F.count(train).over(every) * F.max(train).over(own))
    return per.withColumn("class_weight", F.when(F.col("class").isNotNull(), F.round(weight, 6)))


TRAINING_SET_SUMMARY_SQL = f"""WITH {DEDUP_STRAT_SQL.removeprefix('')} ,
chunks AS (SELECT class, split, record_id, substring(seq, i * 512 + 1, 512) AS seq
           FROM strat, unnest(range(0, CAST(ceil(length(seq) / 512.0) AS BIGINT))) AS t(i)),
per AS (SELECT class, split, count(DISTINCT record_id) AS n_records, count(*) AS n_chunks,
               CAST(sum(length(seq)) AS BIGINT) AS n_residues FROM chunks GROUP BY 1, 2),
tc AS (SELECT class, count(*) AS n_class FROM chunks WHERE split = 'train' GROUP BY 1),
w AS (SELECT class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS class_weight
      FROM tc)
SELECT per.*, w.class_weight FROM per LEFT JOIN w USING (class)"""

query("training_set_summary", TRAINING_SET_SUMMARY_SQL)(training_set_summary)


# ------------------------------------------------------------- aggregations


@query("dedupe_by_sequence", f"""WITH {DEDUP_SQL}
SELECT record_id, class, md5(seq) AS seq_md5, length(seq) AS seq_len FROM dd""")
def q_dedupe(spark, sf):
    return deduped(spark, sf).select("record_id", "class", "seq_md5", "seq_len")


@query("count_per_class", f"""WITH {REC_SQL}
SELECT class, count(*) AS n_records FROM rec GROUP BY class""")
def q_count_per_class(spark, sf):
    return curate.count_per_class(records(spark, sf))


@query("shape_counts", f"""WITH {STRAT_SQL}
SELECT split, count(*) AS n_rows, 9 AS n_columns FROM strat GROUP BY split""")
def q_shape_counts(spark, sf):
    sp = split.stratified_split(records(spark, sf), "class", 0.1, SEED)
    return curate.shape_counts(sp).withColumn("n_columns", F.col("n_columns").cast("int"))


@query("distinct_families", f"""WITH {REC_SQL}
SELECT family, count(*) AS n_rows FROM rec GROUP BY family""")
def q_distinct_families(spark, sf):
    return curate.distinct_families(records(spark, sf))


@query("class_weights", f"""WITH {REC_SQL},
chunks AS (SELECT class FROM rec, unnest(range(0, CAST(ceil(length(seq) / 512.0) AS BIGINT))) AS t(i)),
tc AS (SELECT class, count(*) AS n_class FROM chunks GROUP BY 1)
SELECT class, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight
FROM tc""")
def q_class_weights(spark, sf):
    chunks = chunk_sequence(records(spark, sf), 512)
    return balance.class_weights(chunks).withColumn("weight", F.round("weight", 6))


# ------------------------------------------------------------------ splits


@query("stratified_split", f"""WITH {STRAT_SQL}
SELECT record_id, class, split FROM strat""")
def q_stratified_split(spark, sf):
    return split.stratified_split(records(spark, sf), "class", 0.1, SEED).select(
        "record_id", "class", "split")


@query("family_split", f"""WITH {FAMILY_SQL}
SELECT record_id, family,
       CASE WHEN family IN (SELECT family FROM testf) THEN 'test' ELSE 'train' END AS split
FROM rec""")
def q_family_split(spark, sf):
    return split.family_split(records(spark, sf), 0.2, SEED).select(
        "record_id", "family", "split")


@query("split_progress", f"""WITH {FAMILY_SQL}
SELECT family, n_rows, cum_rows, cum_families,
       round(cum_rows * 100.0 / (SELECT total FROM tot), 6) AS pct_rows,
       round(cum_families * 100.0 / (SELECT count(*) FROM fam), 6) AS pct_families
FROM testf""")
def q_split_progress(spark, sf):
    return split.split_progress(records(spark, sf), 0.2, SEED)


@query("random_split", f"""WITH {REC_SQL},
r AS (SELECT record_id, row_number() OVER (ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn
      FROM rec)
SELECT record_id, CASE WHEN rn <= (SELECT ceil(count(*) * 0.2) FROM rec) THEN 'test' ELSE 'train' END
       AS split FROM r""")
def q_random_split(spark, sf):
    return split.random_split(records(spark, sf), 0.2, SEED).select("record_id", "split")


@query("exact_fraction", f"""WITH {REC_SQL},
r AS (SELECT record_id, class, row_number() OVER (ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn
      FROM rec)
SELECT record_id, class FROM r WHERE rn <= (SELECT round_even(count(*) * 0.105, 0) FROM rec)""")
def q_exact_fraction(spark, sf):
    return curate.exact_fraction(records(spark, sf), 0.105, SEED, "record_id").select(
        "record_id", "class")


@query("sample_n", f"""WITH {REC_SQL},
r AS (SELECT record_id, row_number() OVER (ORDER BY md5(concat('7', ':', record_id)), record_id) AS rn
      FROM rec)
SELECT record_id FROM r WHERE rn <= 100""")
def q_sample_n(spark, sf):
    return curate.sample_n(records(spark, sf), 100, 7, "record_id").select("record_id")


@query("first_row", f"""WITH {REC_SQL}
SELECT record_id, md5(seq) AS seq_md5 FROM rec ORDER BY record_pos LIMIT 1""")
def q_first_row(spark, sf):
    return curate.first_row(records(spark, sf)).select("record_id", F.md5("seq").alias("seq_md5"))


@query("topn_per_term", f"""WITH {REC_SQL},
r AS (SELECT record_id, family, row_number() OVER (PARTITION BY family
             ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn FROM rec)
SELECT family, record_id FROM r WHERE rn <= 7""")
def q_topn_per_term(spark, sf):
    return split.topn_per_group(records(spark, sf), "family", 7, SEED).select(
        "family", "record_id")


@query("capped_per_class_load", """SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label
         ORDER BY md5(concat('42', ':', vec_id)), vec_id) AS rn FROM embeddings) WHERE rn <= 30""")
def q_capped_per_class_load(spark, sf):
    from residuum.sources.tables import capped_per_class_load
    from residuum.sources.testbed import read_table
    e = read_table(spark, sf, "embeddings")
    return capped_per_class_load(e, "label", 30, SEED, "vec_id").select("vec_id", "label")


# --------------------------------------------------------------- chunking


@query("chunk_sequence", f"""WITH {REC_SQL}
SELECT record_id, i AS chunk_id, substring(seq, i * 512 + 1, 512) AS seq
FROM rec, unnest(range(0, CAST(ceil(length(seq) / 512.0) AS BIGINT))) AS t(i)""")
def q_chunk_sequence(spark, sf):
    return chunk_sequence(records(spark, sf), 512).select(
        "record_id", F.col("chunk_id").cast("long"), "seq")


# ------------------------------------------------------------------- joins


@query("split_by_ids", f"""WITH {DEDUP_STRAT_SQL}
SELECT r.record_id, r.class, s.split FROM rec r
JOIN strat s ON r.record_id = s.record_id AND r.class = s.class""")
def q_split_by_ids(spark, sf):
    recs = records(spark, sf)
    firsts = curate.dedupe_by_sequence(recs, CLASS_ORDER, keep=["record_id", "class"], with_seq=False)
    sp = split.stratified_split(firsts, "class", 0.1, SEED)
    tr = sp.where(F.col("split") == "train").select("record_id", "class")
    va = sp.where(F.col("split") == "validation").select("record_id", "class")
    return curate.split_by_ids(recs, tr, va).select("record_id", "class", "split")


@query("family_partition", f"""WITH {REC_SQL}
SELECT record_id, family,
       CASE WHEN family IN ('src1', 'src11', 'src3') THEN 'test' ELSE 'train' END AS split
FROM rec""")
def q_family_partition(spark, sf):
    fams = spark.createDataFrame([("src1",), ("src11",), ("src3",)], "family string")
    return curate.family_partition(records(spark, sf), fams).select(
        "record_id", "family", "split")


@query("term_variants", f"""WITH {REC_SQL},
terms AS (SELECT DISTINCT class AS term FROM rec),
suffixes AS (SELECT * FROM (VALUES (''), ('a'), ('b'), ('c'), ('d')) AS s(suffix))
SELECT term, suffix, concat(term, suffix) AS variant FROM terms, suffixes""")
def q_term_variants(spark, sf):
    terms = records(spark, sf).select(F.col("class").alias("term")).distinct()
    suff = spark.createDataFrame([(s,) for s in ["", "a", "b", "c", "d"]], "suffix string")
    return (terms.crossJoin(F.broadcast(suff))
            .select("term", "suffix", F.concat("term", "suffix").alias("variant")))


@query("union_classes", f"""WITH {REC_SQL}
SELECT class, count(*) AS n_records, CAST(sum(length(seq)) AS BIGINT) AS n_residues
FROM rec GROUP BY class""")
def q_union_classes(spark, sf):
    """One table for each class, as SRC1 + SNK2 leave them (null is one), is a frame
    of its own; one of them has no class column until the union adds it."""
    out = scratch_path(spark, "union")
    recs = records(spark, sf).select("record_id", "seq", "class")
    recs.write.partitionBy("class").parquet(out)
    found = spark.read.parquet(out).select("record_id", "seq", F.col("class").cast("string").alias("class"))
    classes = [r["class"] for r in found.select("class").distinct().collect()]  # the folders
    frames = [found.where(F.col("class").eqNullSafe(F.lit(c))) for c in classes]
    u = curate.union_classes([f.drop("class") if c is None else f for f, c in zip(frames, classes)])
    return u.groupBy("class").agg(F.count(F.lit(1)).alias("n_records"),
                                  F.sum(F.length("seq")).cast("long").alias("n_residues"))
