"""Model queries.  Their oracles state what SQL can know of a fit: the rows and
classes scored, that probabilities sum to one, that a model beats the majority
class, that the normal equations hold, the spectrum's trace."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from residuum.functions.residues import residue_only
from residuum.operators import annotate, balance, embed, metrics as M, models, split
from residuum.plans.classify import classify_fasta
from residuum.plans.q_annotate import SITES_SQL, with_sites
from residuum.plans.q_curate import FAMILY_SQL, STRAT_SQL
from residuum.plans.registry import query
from residuum.session import scratch_path
from residuum.sinks import writers
from residuum.sources.testbed import REC_SQL, read_table, records
from residuum.streaming.stream import stream_classify_fasta

SEED = 42


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def encoded_split(spark, sf):
    """Records with k-mer vectors and a stratified 90/10 split."""
    r = records(spark, sf).select("record_id", "seq", "class", "description", "source_file")
    # encoded after the split, written once: fits and scores read the table
    path = scratch_path(spark, "encoded")
    embed.embed_sequences(split.stratified_split(r, "class", 0.1, SEED)).write.parquet(path)
    return spark.read.parquet(path)


def fitted(spark, sf):
    sp = encoded_split(spark, sf)
    model = models.train_shallow(sp.where(F.col("split") == "train"), "embedding", "class", SEED)
    return model, sp


def beats_majority(scored, y, p):
    """Per class: validation rows, and whether accuracy is above the majority share."""
    cm = M.confusion_table(scored, y, p)
    hit = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    per = cm.groupBy("y").agg(F.sum("n").alias("n_validation"), hit.alias("hits"))
    every = Window.partitionBy()
    return per.select(F.col("y").alias("class"), "n_validation",
                      (F.sum("hits").over(every) > F.max("n_validation").over(every)).alias("beats_majority"))


SCORED_SQL = f"""WITH {STRAT_SQL}
SELECT class, count(*) AS n_validation, true AS beats_majority
FROM strat WHERE split = 'validation' GROUP BY class"""


@query("train_shallow", SCORED_SQL)
def q_train_shallow(spark, sf):
    model, sp = fitted(spark, sf)
    scored = models.score_shallow(model, sp.where(F.col("split") == "validation"))
    return beats_majority(scored, "class", "predicted_label")


@query("score_shallow", f"""WITH {STRAT_SQL}
SELECT record_id, true AS known_class, true AS sums_to_one FROM strat WHERE split = 'validation'""")
def q_score_shallow(spark, sf):
    model, sp = fitted(spark, sf)
    s = models.score_shallow(model, sp.where(F.col("split") == "validation").drop("class"))
    total = F.aggregate("prediction_probability", F.lit(0.0), lambda a, x: a + x)
    return s.select("record_id", F.col("predicted_label").isin(*model.stages[0].labels).alias("known_class"),
                    (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("save_model", f"""WITH {STRAT_SQL}
SELECT count(*) AS n_scored, CAST(0 AS BIGINT) AS n_mismatch FROM strat WHERE split = 'validation'""")
def q_save_model(spark, sf):
    model, sp = fitted(spark, sf)
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    again = models.load_model(path)
    v = sp.where(F.col("split") == "validation")
    a = models.score_shallow(model, v).select("record_id", F.col("prediction").alias("p1"))
    b = models.score_shallow(again, v).select("record_id", F.col("prediction").alias("p2"))
    j = a.join(b, "record_id")
    return j.agg(F.count(F.lit(1)).alias("n_scored"),
                 F.sum((F.col("p1") != F.col("p2")).cast("int")).cast("long").alias("n_mismatch"))


@query("weighted_classifier", SCORED_SQL)
def q_weighted_classifier(spark, sf):
    sp = encoded_split(spark, sf)
    dic = annotate.class_dictionary(sp)
    coded = annotate.class_code(sp, dictionary=dic)
    train = coded.where(F.col("split") == "train")
    w = balance.class_weights(train, "code")
    lr = models.weighted_classifier(train, w, "embedding", "code", "code")
    v = coded.where(F.col("split") == "validation").withColumn("features", array_to_vector("embedding"))
    scored = lr.transform(v).select("class", "code", F.col("prediction").cast("int").alias("p"))
    # class names stand for codes one to one
    return beats_majority(scored.join(dic.select(F.col("class").alias("predicted"), F.col("code").alias("p")), "p"),
                          "class", "predicted")


@query("residue_classifier", f"""WITH {FAMILY_SQL.replace(REC_SQL, SITES_SQL)},
test AS (SELECT labels FROM masks WHERE family IN (SELECT family FROM testf)),
r AS (SELECT unnest(labels) AS label FROM test),
wt AS (SELECT CAST(sum(len(labels)) AS BIGINT) AS n, CAST(sum(list_sum(labels)) AS BIGINT) AS n1 FROM masks
       WHERE family IS NULL OR family NOT IN (SELECT family FROM testf))
SELECT label, count(*) AS n_residues, CASE WHEN label = 1 THEN (SELECT n1 FROM wt) ELSE (SELECT n - n1 FROM wt) END
       AS n_train_residues, true AS all_scored FROM r GROUP BY label""")
def q_residue_classifier(spark, sf):
    sp = split.family_split(with_sites(spark, sf, packed=True), 0.2, SEED)
    path = scratch_path(spark, "windows")  # fit and scores read the counted windows
    models.counted_windows(sp, "seq", "labels", 3, keep=["split"]).write.parquet(path)
    win = spark.read.parquet(path)
    # weights and fit see training families only
    path = scratch_path(spark, "weights")
    balance.token_class_weights(sp.where(F.col("split") == "train"), "labels").write.parquet(path)
    w = spark.read.parquet(path)  # two rows
    model = models.residue_classifier(win.where(F.col("split") == "train"), w)
    # a residue's score is that of its context
    pred = model.transform(models.context_counts(win.where(F.col("split") == "test")))
    per = pred.groupBy("label").agg(F.sum("n").alias("n_residues"),
                                    F.bool_and(F.col("prediction").isin(0.0, 1.0)).alias("all_scored"))
    return per.join(w.select("label", F.col("n_label").alias("n_train_residues")), "label")


@query("vector_regression", f"""WITH {REC_SQL}
SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_train, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n_test,
       true AS normal_equations, true AS scalar_normal_equations, true AS finite FROM rec""")
def q_vector_regression(spark, sf):
    d = read_table(spark, sf, "documents")
    xy = embed.embed_annotation_text(embed.embed_sequences(d.select(
        F.col("doc_id").cast("string").alias("record_id"), residue_only(F.col("text")).alias("seq"), "text")),
        out="target").select("record_id", "embedding", "target", F.length("seq").alias("scalar"))
    path = scratch_path(spark, "regression")  # fits and test read it
    split.random_split(xy, 0.2, SEED).write.parquet(path)
    sp = spark.read.parquet(path)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    coef = models.fit_ridge(train, "embedding", "target", embed.N_SEQ_BUCKETS, embed.N_TEXT_BUCKETS, alpha=1.0)
    one = models.fit_ridge(train, "embedding", "scalar", embed.N_SEQ_BUCKETS, alpha=1.0)
    scored = models.predict_ridge(test, coef, "embedding")
    m = M.regression_metrics(scored.select(F.col("target").alias("y"), F.col("prediction").alias("p")))
    sizes = sp.agg(F.count_if(F.col("split") == "train").alias("n_train"),
                   F.count_if(F.col("split") == "test").alias("n_test"))
    return sizes.crossJoin(m).select(
        "n_train", "n_test",
        F.lit(models.ridge_residual(train, coef, "embedding", "target") < 1e-8).alias("normal_equations"),
        F.lit(models.ridge_residual(train, one, "embedding", "scalar") < 1e-8).alias("scalar_normal_equations"),
        (F.col("mse").isNotNull() & ~F.isnan("mse") & (F.col("mse") < 1)).alias("finite"))


@query("pca", """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
t AS (SELECT sum(var) AS trace FROM (SELECT var_samp(v) AS var FROM x GROUP BY d))
SELECT count(*) AS n_rows, 5 AS n_components, 0 AS means_off_zero, 0 AS covariances_off_zero,
       (SELECT trace FROM t) > 0 AS within_trace FROM embeddings""")
def q_pca(spark, sf):
    e = read_table(spark, sf, "embeddings")
    out, explained = models.pca(e, "embedding", 5)
    pc = [F.col("pcs")[i] for i in range(5)]
    pairs = [(i, j) for i in range(5) for j in range(i)]
    trace = M.per_dim(e.select(F.col("embedding").alias("y"), F.col("embedding").alias("p")), "y", "p") \
        .groupBy("dim").agg(F.var_samp("y").alias("v")).agg(F.sum("v").alias("trace"))
    got = out.agg(F.count(F.lit(1)).alias("n_rows"),
                  sum((F.abs(F.avg(c)) > 1e-6).cast("int") for c in pc).alias("means_off_zero"),
                  sum((F.abs(F.covar_samp(pc[i], pc[j])) > 1e-6).cast("int") for i, j in pairs)
                  .alias("covariances_off_zero"),
                  sum(F.var_samp(c) for c in pc).alias("variance"))
    share = F.lit(float(sum(explained)))
    return got.crossJoin(trace).select(
        "n_rows", F.lit(5).alias("n_components"), "means_off_zero", "covariances_off_zero",
        ((F.col("variance") > 0) & (F.abs(F.col("variance") / F.col("trace") - share) < 1e-6)).alias("within_trace"))


def _fasta_inputs(spark, sf):
    """Gzip FASTA files of both name styles."""
    root = scratch_path(spark, "classify")
    writers.write_fasta(records(spark, sf), root, ["class"], compression="gzip", plain_names=True)
    return root


SCORED_FASTA_SQL = f"""WITH {REC_SQL}
SELECT record_id, description AS info, length(seq) AS seq_len, true AS scored FROM rec
WHERE contains(description, 'CR=1')"""


def _scored(hits):
    total = F.aggregate("prediction_probability", F.lit(0.0), lambda a, x: a + x)
    return hits.select("record_id", "info", F.length("sequence").cast("long").alias("seq_len"),
                       (F.abs(total - 1) < 1e-9).alias("scored"))


@query("classify_fasta", SCORED_FASTA_SQL)
def q_classify_fasta(spark, sf):
    """The whole job with the hit filter off: every record that the header
    filter keeps is scored once."""
    model, _ = fitted(spark, sf)
    out = scratch_path(spark, "hits")
    classify_fasta(spark, _fasta_inputs(spark, sf) + "/", model, out, "CR=1", 0, None)
    return _scored(spark.read.parquet(out))


@query("stream_classify_ranges", SCORED_FASTA_SQL)
def q_stream_classify_ranges(spark, sf):
    """The stream whose offset lies inside files, a megabyte a step."""
    model, _ = fitted(spark, sf)
    out = scratch_path(spark, "range-hits")
    q = stream_classify_fasta(spark, _fasta_inputs(spark, sf), model, out, scratch_path(spark, "range-ckpt"),
                              hit_class=None, step_bytes=1 << 20)
    q.processAllAvailable()
    q.stop()
    return _scored(spark.read.parquet(out))


@query("stream_classify_fasta", SCORED_FASTA_SQL)
def q_stream_classify_fasta(spark, sf):
    model, _ = fitted(spark, sf)
    out = scratch_path(spark, "stream-hits")
    q = stream_classify_fasta(spark, _fasta_inputs(spark, sf), model, out, scratch_path(spark, "stream-ckpt"),
                              hit_class=None)
    q.awaitTermination()
    return _scored(spark.read.parquet(out))
