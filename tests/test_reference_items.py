"""Search memo, batch packing, encoder budgets, scoring and sinks under odd input."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residuum.operators import embed, evolve, models
from residuum.operators.batching import length_bucketed_batches
from residuum.sinks import writers
from residuum.sources import tables


def test_generations_encode_each_sequence_once(spark):
    """Encoder calls equal the distinct (candidate, sequence) pairs of all generations."""
    calls = spark.sparkContext.accumulator(0)

    def counting(col):
        @F.pandas_udf("array<double>")
        def enc(s: pd.Series) -> pd.Series:
            calls.add(len(s))
            return s.map(lambda x: [float(x.count(c)) for c in "ACDEFGHIKLMNPQRSTVWY"])
        return enc.asNondeterministic()(col)

    c = spark.createDataFrame([("a", "MKVLATGGSSP" * 6), ("b", "ACDEFGHIKLW" * 7)], "candidate_id string, seq string")
    t = c.select("candidate_id", counting(F.col("seq")).alias("target")).checkpoint()
    calls.value = 0
    ngen, n = 6, 8
    pop, log, best = evolve.run_generations(c, t, ngen, n, 3, checkpoint_every=2, encoder=counting)
    rows = pop.count()
    assert rows == 2 * n and log.count() == 2 * (ngen + 1)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/memo-test-{random.random()}"
    calls.value = 0
    pop, log, best = evolve.run_generations(c, t, ngen, n, 3, checkpoint_every=2, encoder=counting, memo_path=path)
    memo = spark.read.option("recursiveFileLookup", "true").parquet(path)
    known = memo.select("candidate_id", "digest").distinct().count()
    assert calls.value == memo.count() == known < 2 * n * (ngen + 1)
    # the memo holds what a plain evaluation says
    plain = evolve.evaluate(pop.drop("fitness"), t, counting).select("candidate_id", "individual_id", F.col("fitness").alias("f"))
    assert pop.join(plain, ["candidate_id", "individual_id"]).where("abs(fitness - f) > 1e-12 or (fitness is null) != (f is null)").count() == 0
    assert best.count() == 2


def test_cosine_fitness(spark):
    c = spark.createDataFrame([("a", "MKVLATGGSSP" * 6)], "candidate_id string, seq string")
    t = embed.embed_sequences(c).select("candidate_id", F.col("embedding").alias("target"))
    assert evolve.evaluate(c, t, measure="cosine").first().fitness == pytest.approx(1.0)
    with pytest.raises(ValueError):
        evolve.evaluate(c, t, measure="other")


def test_widened_bands_equal_the_plain_distance(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 40, 300, 900):
        for share in (0, .02, .2, 1):
            a = "".join(rng.choice("ACDE") for _ in range(n))
            b = "".join(rng.choice("ACDE") if rng.random() < share else ch for ch in a)[rng.randint(0, 3):] + "A" * rng.randint(0, 3)
            rows.append((a, b))
    rows += [(None, "A"), ("ACD", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(evolve.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("e")).collect()
    assert [r.d for r in got] == [r.e for r in got]
    long = "".join(rng.choice("ACDEFGHIKL") for _ in range(20_000))
    other = long[:7_000] + "W" + long[7_001:]
    assert spark.createDataFrame([(long, other)], "a string, b string").select(
        evolve.edit_distance(F.col("a"), F.col("b")).alias("d")).first().d == 1


@pytest.mark.parametrize("seed", range(4))
def test_batches_are_the_fewest_of_a_sorted_list(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 7, 7, 7, 50, rng.randint(0, 400), 999]) for _ in range(rng.choice([1, 60, 400]))]
    df = spark.createDataFrame([(f"r{i}", "A" * n) for i, n in enumerate(lengths)] + [("null", None)], "record_id string, seq string")
    got = length_bucketed_batches(df, budget=300, extra=1).collect()
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r.length)
    assert len(got) == len(lengths) + 1 and sorted(batches) == list(range(len(batches)))
    assert all(len(b) == 1 or (max(b) + 1) * len(b) <= 300 for b in batches.values())
    ordered = [n for b in sorted(batches) for n in sorted(batches[b], reverse=True)]
    assert ordered == sorted(ordered, reverse=True)
    ascending, n = 1, 0  # greedy from the shortest
    for size in sorted(x + 1 for x in lengths + [0]):
        if n and size * (n + 1) > 300:
            ascending, n = ascending + 1, 0
        n += 1
    assert len(batches) <= ascending


def test_no_batches_of_an_empty_table(spark):
    assert length_bucketed_batches(spark.createDataFrame([], "record_id string, seq string")).collect() == []


def test_budget_encoder_keeps_budget_and_order(spark):
    def make():
        def predict(texts):
            longest = max(len(t) + 2 for t in texts)
            assert len(texts) == 1 or longest * len(texts) <= 200
            return np.array([[len(t), t.count("A")] for t in texts], dtype=np.float32)
        return predict

    rng = random.Random(1)
    rows = [(i, None if i % 17 == 0 else "A" * rng.randint(0, 30) + "C" * rng.choice([0, 5, 500])) for i in range(400)]
    enc = embed.budget_encoder(make, 2, token_budget=200)
    got = spark.createDataFrame(rows, "i int, seq string").withColumn("v", enc(F.col("seq"))).collect()
    for r in got:
        assert r.v == (None if r.seq is None else [len(r.seq), r.seq.count("A")])


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_rows_of_null_and_unseen_classes_are_scored(spark, kind):
    rows = [([float(i % 2), 1.0], "ab"[i % 2]) for i in range(40)]
    model = models.train_shallow(spark.createDataFrame(rows, "embedding array<double>, class string"), num_trees=3, kind=kind)
    odd = spark.createDataFrame([([0.0, 1.0], None), ([1.0, 1.0], "zzz"), ([1.0, 1.0], "a")], "embedding array<double>, class string")
    got = models.score_shallow(model, odd).collect()
    assert len(got) == 3
    assert {(r["class"], r.predicted_label) for r in got} == {(None, "a"), ("zzz", "b"), ("a", "b")}
    assert models.score_shallow(model, odd.drop("class")).count() == 3


def test_fit_on_distinct_contexts_equals_fit_on_residues(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher
    rng = random.Random(2)
    seqs = [("".join(rng.choice("ACKR") for _ in range(60))) for _ in range(40)]
    rows = [(f"r{i}", s, [int(c == "K" and rng.random() < .8) for c in s]) for i, s in enumerate(seqs)]
    win = models.residue_windows(spark.createDataFrame(rows, "id string, seq string, labels array<int>"), "id", "seq", "labels", 1)
    weights = spark.createDataFrame([(0, 0.7), (1, 2.1)], "label int, weight double")
    assert models.context_counts(win).agg(F.sum("n")).first()[0] == win.count() > models.context_counts(win).count()
    model = models.residue_classifier(win, weights, 1 << 8, 50)
    ctx = models.context_columns(win)
    d = win.join(weights, "label").withColumn("label_d", F.col("label").cast("double"))
    plain = Pipeline(stages=[FeatureHasher(inputCols=ctx, outputCol="features", numFeatures=1 << 8, categoricalCols=ctx),
                             LogisticRegression(featuresCol="features", labelCol="label_d", weightCol="weight", maxIter=50)]).fit(d)
    def scores(m):
        return {(r.id, r.pos): r.probability[1] for r in m.transform(win).collect()}
    a, b = scores(model), scores(plain)
    assert max(abs(a[k] - b[k]) for k in b) < 0.02


def test_metrics_of_a_rerun_replace(spark, tmp_path):
    path = f"{tmp_path}/runs"
    row = spark.createDataFrame([("m", 0.5)], "model_name string, accuracy double")
    writers.append_run_metrics(row, path, "run-1")
    writers.append_run_metrics(row.withColumn("accuracy", F.lit(0.25)), path, "run-2")
    writers.append_run_metrics(row.withColumn("accuracy", F.lit(0.75)), path, "run-1")
    assert sorted((r.run_id, r.accuracy) for r in spark.read.parquet(path).collect()) == [("run-1", 0.75), ("run-2", 0.25)]


def test_first_rows_with_ties_and_nulls(spark, tmp_path):
    from pyspark.sql import types as T
    rows = [(k, "x" * 50) for k in [3, None, 1, 2, 2, 2, 5, None]]
    df = spark.createDataFrame(rows, "k int, v string")
    df.write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    for n in (0, 1, 2, 3, 5, 8, 20):
        got = tables.read_tsv(spark, f"{tmp_path}/t", schema, n, "k")
        assert sorted((r.k is not None, r.k or 0) for r in got.collect()) == sorted((k is not None, k or 0) for k, _ in rows)[:n]


def _exchanged(plan: str) -> list[str]:
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


@pytest.mark.parametrize("group", [None, "class"])
def test_selection_moves_few_rows(spark, tmp_path, group, monkeypatch):
    """Radix selection ranks the rows of the boundary buckets only; others are not shuffled."""
    from residuum.functions.hashing import rank_key
    from residuum.operators import ranking
    n = 400_000
    spark.range(n).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").alias("class"),
                          F.repeat(F.lit("x"), 20).alias("payload")).write.parquet(f"{tmp_path}/w")
    df = spark.read.parquet(f"{tmp_path}/w")
    edges, plain = [], ranking._edge_rows
    monkeypatch.setattr(ranking, "_edge_rows", lambda *a: edges.append(plain(*a)) or edges[-1])
    sel = ranking.prefix_select(df, rank_key(3, "record_id"), F.col("record_id"), 12_345, [group] if group else None)
    assert edges[0].count() < 0.01 * n
    assert not any("payload" in line for line in _exchanged(sel._jdf.queryExecution().executedPlan().toString()))
    counts = {r["class"]: r["count"] for r in sel.where("selected").groupBy("class").count().collect()}
    assert counts == {"a": 12_345, "b": 12_345, None: 12_345} if group else sum(counts.values()) == 12_345


@pytest.mark.parametrize("groups", [0, 3, 20_000])
def test_selection_equals_a_plain_rank(spark, monkeypatch, groups):
    """With broadcast bounds and, beyond their number, with a shuffle; weights, ties, null groups, limits of 0 and none."""
    from pyspark.sql import Window
    from residuum.functions.hashing import rank_key
    from residuum.operators import ranking
    monkeypatch.setattr(ranking, "BROADCAST_GROUPS", groups)
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("k"), (F.col("id") % 7 + 1).alias("w"),
                                  F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("string")).alias("g"), F.col("id"))
    limits = spark.createDataFrame([("0", 500), ("1", 0), (None, 77), ("2", 10 ** 6)], "g string, `limit` long")
    got = ranking.prefix_select(df, rank_key(1, "k"), F.col("id"), limits, ["g"], F.col("w")).where("selected").select("id")
    w = Window.partitionBy("g").orderBy(rank_key(1, "k"), "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("c", F.sum("w").over(w) - F.col("w")).join(limits.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))) \
        .where("c < limit").select("id")
    assert sorted(got.collect()) == sorted(plain.collect())


def test_title_index_reads_matching_partitions(spark, tmp_path):
    from residuum.sources import catalogue
    rng = random.Random(0)
    names = ["kinase", "kinases", "ligase", "the", "of", "protein"] + [f"w{i}" for i in range(500)]
    rows = [(f"r{i % 900}", " ".join(rng.choices(names, k=8)) + rng.choice(["", " Kinase", " the-the"])) for i in range(1000)] + [("x", None), (None, "the")]
    df = spark.createDataFrame(rows, "record_id string, title string")
    path = f"{tmp_path}/index"
    catalogue.write_title_index(df, path)
    got = catalogue.search_title_index(spark, path, ["kinase", "the", "absent"], 20)
    assert sorted(map(str, got.collect())) == sorted(map(str, catalogue.title_term_search(df, ["kinase", "the", "absent"], 20).select(*got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(tok" in plan
    found = catalogue.search_title_index(spark, path, ["ligase"], 10, suffixes=[""])
    assert found.count() == 10
