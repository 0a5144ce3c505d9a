"""FASTA edge cases, streams, sinks, plans and models beyond the oracles."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.operators import embed, models, split
from residuum.sources import fasta, tables

SF = "/root/testdata/sf0.001"
MESSY = "; a comment\n>r1 one\nMK\nT\n>\nAAA\n> \t\nCCC\n>r2 a>b\r\nGG\r\n>>r3\nLL\n"


def _write(path, text, packed):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open(path, "wt", newline="") if packed else open(path, "w", newline="")) as f:
        f.write(text)


@pytest.fixture()
def tree(tmp_path):
    _write(f"{tmp_path}/t/c1/mgy_proteins_1.fa.gz", MESSY, True)
    _write(f"{tmp_path}/t/c1/a.fasta", MESSY, False)
    _write(f"{tmp_path}/t/c2/b.fasta.gz", ">x\nMKV\n", True)
    _write(f"{tmp_path}/t/c2/skip.txt", ">no\nM\n", False)
    return f"{tmp_path}/t/"


def test_headerless_kept_and_lead_text_rejected(spark, tree):
    got = fasta.read_fasta_input(spark, tree)
    per_file = got.where(F.col("source_file").endswith("a.fasta")).orderBy("record_pos").collect()
    assert [(r.record_id, r.seq) for r in per_file] == [("r1", "MKT"), ("", "AAA"), ("", "CCC"), ("r2", "GG"), (">r3", "LL")]
    assert got.count() == 11
    rejects = fasta.fasta_rejects(spark, tree, recursive=True, file_regex=fasta.FASTA_NAME_REGEX)
    assert {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()} == {
        "text before the first record": 2, "record without a header": 4}


def test_stream_reads_what_batch_reads(spark, tree, tmp_path):
    from residuum.streaming.stream import fasta_stream
    out = f"{tmp_path}/out"
    fasta_stream(spark, tree).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck") \
        .trigger(availableNow=True).start(out).awaitTermination()
    key = ["record_id", "seq", "source_file"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*key).collect())) == \
        sorted(map(tuple, fasta.read_fasta_input(spark, tree).select(*key).collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_encode_above_the_exchange(spark, tree):
    from residuum.plans.classify import score_records
    recs = fasta.read_fasta_input(spark, tree, class_from_folder=False).drop("record_pos")
    train = embed.embed_sequences(spark.createDataFrame(
        [("MKVLAT" * 5, "a"), ("GGGSSP" * 5, "b")] * 10, "seq string, class string"))
    model = models.train_shallow(train.checkpoint(), num_trees=3)
    plan = _plan(score_records(recs, model, None, 0, 0))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("RoundRobinPartitioning")
    hits = score_records(recs, model, None, 0, None, 0.6)
    assert dict(hits.dtypes)["prediction_probability"] == "array<double>"
    assert hits.where(F.array_max("prediction_probability") < 0.6).count() == 0


def test_top_n_plans(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 3).alias("g"))
    assert "WindowGroupLimit" in _plan(split.topn_per_group(df, "g", 5))
    from residuum.operators.curate import sample_n
    assert "TakeOrderedAndProject" in _plan(sample_n(df, 5, 1, "record_id"))


def test_splits_read_wide_rows_once(spark, tmp_path):
    spark.range(200).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 4).cast("string").alias("class"),
                            F.repeat(F.lit("x"), 50).alias("payload")).write.parquet(f"{tmp_path}/w")
    df = spark.read.parquet(f"{tmp_path}/w")
    for s in (split.stratified_split(df), split.random_split(df)):
        scans = [x for x in _plan(s).split("\n") if "FileScan" in x]
        assert sum("payload" in x for x in scans) == 1
        assert s.groupBy("split").count().count() == 2


def test_chunk_split_deals_chunks(spark):
    df = spark.range(40).select(F.lit("r").alias("record_id"), F.col("id").cast("int").alias("chunk_id"), F.lit("c").alias("class"))
    got = {r.split: r["count"] for r in split.chunk_split(df).groupBy("split").count().collect()}
    assert got == {"train": 36, "validation": 4}


def test_hits_rerun_replaces(spark, tmp_path):
    from residuum.sinks.writers import write_hits
    a = spark.createDataFrame([("f1", "r1", [0.1, 0.9]), ("f2", "r2", [0.2, 0.8])], "source_file string, id string, p array<double>")
    for df in (a, a, a.where("source_file = 'f1'")):
        write_hits(df, f"{tmp_path}/h")
    assert spark.read.parquet(f"{tmp_path}/h").count() == 2


def test_checkpoint_folder_must_be_named_off_local():
    from residuum import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_plug_in_encoders(spark):
    def make():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)
        return predict
    enc = embed.model_encoder(make, 2)
    df = spark.createDataFrame([("aab",), ("xyz",)], "seq string")
    assert [r.embedding for r in embed.embed_sequences(df, encoder=enc).orderBy("seq").collect()] == [[3.0, 2.0], [3.0, 0.0]]
    got = embed.embed_annotation_text(df.withColumnRenamed("seq", "text"), encoder=enc).orderBy("text").collect()
    assert [r.embedding for r in got] == [[3.0, 2.0], [3.0, 0.0]]
    nulls = spark.createDataFrame([(None,)], "seq string")
    assert embed.embed_sequences(nulls).first().embedding is None
    plan = _plan(embed.embed_annotation_text(df.withColumnRenamed("seq", "text")))
    assert "Exchange" not in plan


def test_shallow_models_beat_the_majority(spark):
    rng = np.random.default_rng(1)
    rows = [((c + rng.normal(0, 0.3, 3)).tolist(), "abc"[c]) for c in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "embedding array<double>, class string")
    for kind, data in (("forest", df), ("boosted", df), ("boosted", df.where("class != 'c'"))):
        model = models.train_shallow(data, num_trees=5, kind=kind)
        got = models.score_shallow(model, data).collect()
        assert sum(r.predicted_label == r["class"] for r in got) > 0.9 * len(got)
        assert all(abs(sum(r.prediction_probability) - 1) < 1e-9 for r in got)


def test_ridge_merges_partials(spark, monkeypatch):
    monkeypatch.setattr(models, "MERGE", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + 4.0
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(11)
    coef = models.fit_ridge(df, "x", "y", 4, alpha=1e-9)
    assert np.allclose(coef.ravel(), [1.0, -2.0, 0.5, 3.0, 4.0], atol=1e-6)
    assert models.ridge_residual(df, coef, "x", "y", 1e-9) < 1e-9


def test_paged_rejects_and_layers(spark, tmp_path):
    from residuum.sinks.writers import write_embeddings
    schema = tables.T.StructType([tables.T.StructField(c, tables.T.StringType()) for c in ("accession", "b", "c")])
    _write(f"{tmp_path}/p/page=0/x.tsv", "accession\tb\tc\nP1\t1\t2\nP2\t1\nP3\t1\t2\t3\n", False)
    got = {r.line.split("\t")[0]: r.n_cells for r in tables.paged_tsv_rejects(spark, f"{tmp_path}/p", schema=schema).collect()}
    assert got == {"P2": 2, "P3": 4}
    e = spark.createDataFrame([("r", "c", [1.0], 6, "m", "train"), ("r", "c", [2.0], 33, "m", "train")],
                              "record_id string, class string, embeddings array<double>, layer int, model string, split string")
    write_embeddings(e, f"{tmp_path}/e", ["model", "split", "layer"])
    assert tables.read_embeddings(spark, f"{tmp_path}/e", layer=33).first().mean_representation == [2.0]
    assert tables.read_layer_map(spark, f"{tmp_path}/e").first().representations == {6: [1.0], 33: [2.0]}


def test_generations_keep_one_plan_size(spark):
    """More generations do not make a longer plan: the log is a table."""
    from residuum.operators import evolve
    c = spark.createDataFrame([("a", "MKVLATGGSSP" * 6)], "candidate_id string, seq string")
    t = embed.embed_sequences(c).select("candidate_id", F.col("embedding").alias("target")).checkpoint()
    sizes = []
    for n in (2, 6):
        pop, log, best = evolve.run_generations(c, t, n, 6, 3, checkpoint_every=2)
        assert log.count() == n + 1
        sizes.append(sum(len(_plan(x).split("\n")) for x in (pop, log, best)))
    assert sizes[0] == sizes[1]
