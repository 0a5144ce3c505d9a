"""Invariants over whole test tables (FIXTURES.md section 4)."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from residuum.operators import curate, evolve, split
from residuum.operators.batching import length_bucketed_batches
from residuum.operators.chunk import chunk_sequence
from residuum.operators.ranking import prefix_select
from residuum.functions.hashing import rank_key
from residuum.sources.testbed import CLASS_ORDER, records

SF = "/root/testdata/sf0.001"


def test_chunks_concatenate_to_sequence(spark):
    r = records(spark, SF).select("record_id", "seq")
    ch = chunk_sequence(r, 37)
    back = ch.groupBy("record_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk_id", "seq"))), lambda x: x["seq"]), "").alias("s"))
    bad = back.join(r, "record_id").where(F.col("s") != F.col("seq")).count()
    assert bad == 0
    assert ch.count() == r.where(F.length("seq") > 0).select(
        F.sum(F.ceil(F.length("seq") / 37.0))).first()[0]


def test_splits_are_disjoint_and_exact(spark):
    r = records(spark, SF)
    n = r.count()
    s = split.stratified_split(r, "class", 0.1, 42)
    assert s.count() == n and s.select("record_id").distinct().count() == n
    rs = split.random_split(r, 0.2, 42)
    assert rs.where("split = 'test'").count() == -(-n * 2 // 10)
    fs = split.family_split(r, 0.2, 42)
    both = fs.where(F.col("family").isNotNull()).groupBy("family").agg(
        F.countDistinct("split").alias("k")).where("k > 1").count()
    assert both == 0
    dd = split.stratified_split(curate.dedupe_by_sequence(r, CLASS_ORDER), "class", 0.1, 42)
    assert dd.groupBy("seq").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_prefix_select_matches_row_number(spark):
    r = records(spark, SF).select("record_id", "class")
    sel = prefix_select(r, rank_key(5, "record_id"), F.col("record_id"), 11, ["class"])
    w = Window.partitionBy("class").orderBy(rank_key(5, "record_id"), "record_id")
    exp = r.withColumn("rn", F.row_number().over(w)).where("rn <= 11").select("record_id")
    got = sel.where("selected").select("record_id")
    assert sorted(x[0] for x in got.collect()) == sorted(x[0] for x in exp.collect())


def test_length_batches_respect_budget(spark):
    r = records(spark, SF).select("record_id", "seq")
    b = length_bucketed_batches(r, budget=4096, extra=1)
    stats = b.groupBy("batch_id").agg(F.max("length").alias("mx"), F.count(F.lit(1)).alias("n"))
    assert stats.where("(mx + 1) * n > 4096 and n > 1").count() == 0
    assert b.count() == r.count()


def test_search_invariants(spark):
    r = records(spark, SF)
    first = r.groupBy("class").agg(F.min_by(F.struct("record_id", "seq"), "record_pos").alias("x"))
    cands = first.select(F.col("x.record_id").alias("candidate_id"), "x.seq", "class").limit(2)
    cands = cands.persist()
    from residuum.operators import embed
    prof = embed.embed_sequences(r.select("class", "seq"))
    t = evolve.class_targets(prof, "class").withColumnRenamed("candidate_id", "class")
    t = cands.join(t, "class").select("candidate_id", "target")
    pop, log, best = evolve.run_generations(cands, t, 3, 10, 7, checkpoint_every=2)
    # length constant
    lens = pop.join(cands.select("candidate_id", F.length("seq").alias("L")), "candidate_id")
    assert lens.where(F.length("seq") != F.col("L")).count() == 0
    # best-so-far never falls below any generation's max
    mx = log.groupBy("candidate_id").agg(F.max("max").alias("m"))
    j = mx.join(best, "candidate_id").where(F.col("fitness") < F.col("m") - 1e-12)
    assert j.count() == 0
    assert log.select("generation").distinct().count() == 4


def test_streaming_equals_batch(spark):
    from residuum.plans import q_ml
    model, _ = q_ml.fitted(spark, SF)
    root = q_ml._fasta_inputs(spark, SF)
    from residuum.plans.classify import classify_fasta
    from residuum.session import scratch_path
    from residuum.streaming.stream import stream_classify_fasta
    batch = classify_fasta(spark, root + "/", model, None)
    out = scratch_path(spark, "s")
    stream_classify_fasta(spark, root, model, out, scratch_path(spark, "c")).awaitTermination()
    got = spark.read.parquet(out)
    key = ["record_id", "prediction"]
    assert sorted(tuple(x) for x in got.select(*key).collect()) == \
        sorted(tuple(x) for x in batch.select(*key).collect())


def test_runs_from_another_directory(tmp_path):
    """A driver outside the repo, with a plain session: Python workers must
    still import the package (shipped with addPyFile)."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() > 0
assert E.queries()["embed_sequences"](spark, {SF!r}).count() > 0
print("ok")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    assert out.stdout.strip().endswith("ok"), out.stderr[-2000:]
