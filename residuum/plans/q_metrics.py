"""Metric queries over stand-in predictions derived from the test tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import below, in_slices, keyed, list_like, list_parts, pieces, position_words
from residuum.functions.hashing import hash_bucket
from residuum.operators import metrics as M
from residuum.operators.balance import class_weights
from residuum.operators.ranking import row_index
from residuum.plans.q_annotate import MLM_SQL, masked
from residuum.plans.registry import query
from residuum.sources.testbed import (BIN_SQL, EMB_SQL, SECOND_SQL, binary_rows, embedding_rows,
                                      second_model_embedding)

SEED = 42


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _mc_cm(spark, sf):
    return M.confusion_table(embedding_rows(spark, sf), "label", "prediction")


def _bin_cm(spark, sf):
    b = binary_rows(spark, sf).withColumn("p", M.threshold_label(F.col("p1"), 0.9))
    return M.confusion_table(b, "y", "p")


CM_SQL = EMB_SQL + """,
cm AS (SELECT label AS y, prediction AS p, count(*) AS n FROM emb GROUP BY 1, 2),
classes AS (SELECT y AS c FROM cm UNION SELECT p AS c FROM cm),
tp AS (SELECT y AS c, n AS tp FROM cm WHERE y = p),
pr AS (SELECT p AS c, sum(n) AS n_pred FROM cm GROUP BY 1),
tr AS (SELECT y AS c, sum(n) AS support FROM cm GROUP BY 1),
pc AS (SELECT c, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(support, 0) AS support
       FROM classes LEFT JOIN tp USING (c) LEFT JOIN pr USING (c) LEFT JOIN tr USING (c)),
m1 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0 END AS f1 FROM m1)"""

BCM_SQL = BIN_SQL + """,
cm AS (SELECT y, CASE WHEN p1 >= 0.9 THEN 1 ELSE 0 END AS p, count(*) AS n FROM bin GROUP BY 1, 2),
b AS (SELECT CAST(sum(CASE WHEN y <> 1 AND p <> 1 THEN n ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN y <> 1 AND p = 1 THEN n ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN y = 1 AND p <> 1 THEN n ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN y = 1 AND p = 1 THEN n ELSE 0 END) AS BIGINT) AS tp FROM cm),
bm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM b)"""


@query("threshold_label", f"""WITH {BIN_SQL}
SELECT doc_id, y, CASE WHEN p1 >= 0.9 THEN 1 ELSE 0 END AS pred FROM bin""")
def q_threshold_label(spark, sf):
    b = binary_rows(spark, sf)
    return b.select("doc_id", "y", M.threshold_label(F.col("p1"), 0.9).alias("pred"))


@query("accuracy", f"""WITH {CM_SQL}
SELECT round(sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM cm""")
def q_accuracy(spark, sf):
    return M.accuracy(_mc_cm(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"))


@query("weighted_prf", f"""WITH {CM_SQL}
SELECT round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1 FROM m2""")
def q_weighted_prf(spark, sf):
    w = M.weighted_prf(_mc_cm(spark, sf))
    return w.select(*[r6(F.col(c)).alias(c) for c in w.columns])


@query("balanced_accuracy", f"""WITH {CM_SQL}
SELECT round(avg(recall), 6) AS balanced_accuracy FROM m2 WHERE support > 0""")
def q_balanced_accuracy(spark, sf):
    return M.balanced_accuracy(_mc_cm(spark, sf)).select(
        r6(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query("confusion_matrix", f"""WITH {CM_SQL}
SELECT y, p, CAST(n AS BIGINT) AS n FROM cm""")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_mc_cm(spark, sf))


@query("classification_report", f"""WITH {CM_SQL}
SELECT CAST(c AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL,
       round(sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM cm
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m2""")
def q_classification_report(spark, sf):
    r = M.classification_report(_mc_cm(spark, sf))
    return r.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


@query("binary_prf", f"""WITH {BCM_SQL}
SELECT tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
             ELSE 0.0 END, 6) AS f1 FROM bm""")
def q_binary_prf(spark, sf):
    b = M.binary_metrics(_bin_cm(spark, sf))
    return b.select("tn", "fp", "fn", "tp", *[r6(F.col(c)).alias(c)
                                             for c in ("precision", "recall", "f1")])


@query("hard_auc", f"""WITH {BCM_SQL}
SELECT round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6)
       AS roc_auc FROM b""")
def q_hard_auc(spark, sf):
    return M.binary_metrics(_bin_cm(spark, sf)).select(r6(F.col("roc_auc")).alias("roc_auc"))


@query("mcc", f"""WITH {BCM_SQL}
SELECT round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
       THEN (tp * tn - fp * fn) / sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))
       ELSE 0.0 END, 6) AS mcc FROM b""")
def q_mcc(spark, sf):
    return M.binary_metrics(_bin_cm(spark, sf)).select(r6(F.col("mcc")).alias("mcc"))


# ------------------------------------------------------------ token level

PRED_SQL = MLM_SQL + """,
tm AS (SELECT record_id, labels,
         list_transform(labels, lambda t, i: CASE
            WHEN md5(concat('42-pred', ':', record_id, ':', i - 1)) < '40000000' THEN (t + 1) % 33
            ELSE t END) AS preds,
         list_transform(labels, lambda t, i: 0.05 + 0.9 * CAST(('0x' || substring(
            md5(concat('42-p', ':', record_id, ':', i - 1)), 1, 8)) AS BIGINT) / 4294967296.0) AS p_true
       FROM mlm),
sc AS (SELECT record_id,
         list_filter(list_transform(labels, lambda t, i: struct_pack(l := t, p := preds[i], q := p_true[i])),
                     lambda x: x.l <> -100) AS s FROM tm)"""


def _token_model(spark, sf):
    """Stand-in predictions and probabilities; all three columns are packed."""
    m = masked(spark, sf).select("record_id", "labels")

    @F.arrow_udf(T.BinaryType())
    @in_slices
    def _preds(labels: pa.Array, key: pa.Array) -> pa.Array:
        counts, values = list_parts(labels)
        t = values.to_numpy(zero_copy_only=False)
        wrong = below(position_words(f"{SEED}-pred", key.to_pylist(), counts, 1), "40000000") & keyed(key, counts)
        preds = t.copy()
        preds[wrong] = np.fmod(t[wrong] + 1, 33)  # the remainder keeps the sign, as Spark's
        return list_like(labels, counts, pa.array(preds))

    @F.arrow_udf(T.BinaryType())
    @in_slices
    def _p_true(labels: pa.Array, key: pa.Array) -> pa.Array:
        counts, _ = list_parts(labels)
        u = position_words(f"{SEED}-p", key.to_pylist(), counts, 1)[0].astype(np.float64)
        p = 0.05 + 0.9 * u / 4294967296.0
        if key.null_count:
            p[~keyed(key, counts)] = np.nan
        return pieces(labels, np.concatenate(([0], np.cumsum(counts))), p, pa.binary())

    return m.withColumn("preds", _preds("labels", "record_id")).withColumn("p_true", _p_true("labels", "record_id"))


@query("masked_token_accuracy", f"""WITH {PRED_SQL}
SELECT CAST(sum(len(list_filter(s, lambda x: x.l = x.p))) AS BIGINT) AS n_correct,
       CAST(sum(len(s)) AS BIGINT) AS n_scored,
       round(sum(len(list_filter(s, lambda x: x.l = x.p))) / sum(len(s)), 6) AS accuracy FROM sc""")
def q_masked_token_accuracy(spark, sf):
    a = M.masked_token_accuracy(_token_model(spark, sf))
    return a.select("n_correct", "n_scored", r6(F.col("accuracy")).alias("accuracy"))


PERP_SQL = PRED_SQL + """,
pp AS (SELECT CAST(sum(len(s)) AS BIGINT) AS n_scored,
              sum(list_sum(list_transform(s, lambda x: -ln(x.q)))) AS sum_nll FROM sc)"""


@query("perplexity", f"""WITH {PERP_SQL}
SELECT n_scored, round(sum_nll / n_scored, 6) AS mean_ce, round(exp(sum_nll / n_scored), 6) AS perplexity
FROM pp""")
def q_perplexity(spark, sf):
    p = M.perplexity(_token_model(spark, sf))
    return p.select("n_scored", r6(F.col("mean_ce")).alias("mean_ce"),
                    r6(F.col("perplexity")).alias("perplexity"))


NLL_SQL = ("(list_max(list_transform(logits, lambda x: CAST(x AS DOUBLE))) + ln(list_sum(list_transform("
           "logits, lambda x: exp(CAST(x AS DOUBLE) - list_max(list_transform(logits, "
           "lambda z: CAST(z AS DOUBLE)))))))) - CAST(logits[label + 1] AS DOUBLE)")


@query("weighted_cross_entropy", f"""WITH {EMB_SQL},
cw AS (SELECT label, count(*) AS n_class FROM emb GROUP BY 1),
w AS (SELECT label, sum(n_class) OVER () / (count(*) OVER () * n_class) AS weight FROM cw),
x AS (SELECT emb.*, w.weight, {NLL_SQL} AS nll FROM emb JOIN w USING (label))
SELECT round(sum(weight * nll) / sum(weight), 6) AS weighted_ce, round(avg(nll), 6) AS mean_ce FROM x""")
def q_weighted_cross_entropy(spark, sf):
    e = embedding_rows(spark, sf)
    w = class_weights(e, "label").withColumnRenamed("label", "class")
    r = M.weighted_cross_entropy(e, w, "logits", "label")
    return r.select(r6(F.col("weighted_ce")).alias("weighted_ce"), r6(F.col("mean_ce")).alias("mean_ce"))


@query("argmax", f"""WITH {EMB_SQL}
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM emb""")
def q_argmax(spark, sf):
    return embedding_rows(spark, sf).select("vec_id", M.argmax(F.col("logits")).alias("pred"))


@query("softmax", f"""WITH {EMB_SQL},
e AS (SELECT vec_id, list_transform(logits, lambda x: exp(CAST(x AS DOUBLE) - list_max(
        list_transform(logits, lambda z: CAST(z AS DOUBLE))))) AS ex FROM emb)
SELECT vec_id, round(list_max(ex) / list_sum(ex), 6) AS p_max,
       round(list_min(ex) / list_sum(ex), 6) AS p_min FROM e""")
def q_softmax(spark, sf):
    s = embedding_rows(spark, sf).select("vec_id", M.softmax(F.col("logits")).alias("p"))
    return s.select("vec_id", r6(F.array_max("p")).alias("p_max"), r6(F.array_min("p")).alias("p_min"))


# ------------------------------------------------------------ vector level

DIM_SQL = """dims AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS y,
                     CAST(embedding[i] AS DOUBLE) * 0.9 + (vec_id % 5) * 0.01 AS p
              FROM embeddings, unnest(generate_series(1, len(embedding))) AS t(i))"""

REG_SQL = f"""{DIM_SQL},
ym AS (SELECT dim, avg(y) AS ym FROM dims GROUP BY dim),
per AS (SELECT dim, avg((y - p) ^ 2) AS mse, sum((y - p) ^ 2) AS sse, sum((y - ym) ^ 2) AS sst
        FROM dims JOIN ym USING (dim) GROUP BY dim),
reg AS (SELECT avg(mse) AS mse, avg(sqrt(mse)) AS rmse,
               avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END) AS r2
        FROM per)"""


def _reg_input(spark, sf):
    return embedding_rows(spark, sf).select(F.col("embedding").alias("y"),
                                            second_model_embedding().alias("p"))


@query("regression_metrics", f"""WITH {REG_SQL}
SELECT round(mse, 6) AS mse, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM reg""")
def q_regression_metrics(spark, sf):
    r = M.regression_metrics(_reg_input(spark, sf))
    return r.select(*[r6(F.col(c)).alias(c) for c in r.columns])


@query("pooled_r2", f"""WITH {DIM_SQL}
SELECT round(1 - sum((y - p) ^ 2) / sum((y - (SELECT avg(y) FROM dims)) ^ 2), 6) AS r2 FROM dims""")
def q_pooled_r2(spark, sf):
    return M.pooled_r2(_reg_input(spark, sf)).select(r6(F.col("r2")).alias("r2"))


@query("row_r2", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS t,
                             {SECOND_SQL} AS p FROM embeddings),
s AS (SELECT vec_id, p, t, list_avg(p) AS m FROM v)
SELECT vec_id, round(1 - list_sum(list_transform(p, lambda x, i: (x - t[i]) ^ 2))
                     / list_sum(list_transform(p, lambda x: (x - m) ^ 2)), 6) AS r2 FROM s""")
def q_row_r2(spark, sf):
    e = embedding_rows(spark, sf)
    return e.select("vec_id", r6(M.row_r2(second_model_embedding(), F.col("embedding"), "pred"))
                    .alias("r2"))


@query("dual_task_loss", f"""WITH {PERP_SQL}, {REG_SQL}
SELECT round(sum_nll / n_scored, 6) AS ce, round(reg.mse, 6) AS mse,
       round(0.0 * (sum_nll / n_scored) + 100.0 * reg.mse, 6) AS loss FROM pp, reg""")
def q_dual_task_loss(spark, sf):
    ce = M.perplexity(_token_model(spark, sf)).select("mean_ce")
    mse = M.regression_metrics(_reg_input(spark, sf)).select("mse")
    j = ce.crossJoin(mse)  # two one-row aggregates
    return j.select(r6(F.col("mean_ce")).alias("ce"), r6(F.col("mse")).alias("mse"),
                    r6(M.dual_task_loss(F.col("mean_ce"), F.col("mse"), 0.0, 100.0)).alias("loss"))


@query("epoch_mean_loss", f"""WITH {EMB_SQL},
ep AS (SELECT emb.*, e AS epoch FROM emb, unnest([0, 1, 2]) AS t(e)),
b AS (SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY md5(concat(epoch, ':', vec_id)), vec_id) - 1) // 16
             AS batch_id, {NLL_SQL} AS nll FROM ep),
bl AS (SELECT epoch, batch_id, avg(nll) AS loss FROM b GROUP BY 1, 2)
SELECT epoch, round(avg(loss), 6) AS mean_loss, count(*) AS n_batches FROM bl GROUP BY epoch""")
def q_epoch_mean_loss(spark, sf):
    e = embedding_rows(spark, sf).withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    # per-epoch shuffle order: md5(epoch ':' id)
    e = e.withColumn("_h", F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"),
                                          F.col("vec_id").cast("string"))))
    idx = row_index(e, "epoch", ["_h", "vec_id"], hash_bucket(F.col("_h")), "_ri")
    b = idx.withColumn("batch_id", F.floor(F.col("_ri") / 16)).withColumn(
        "nll", M.nll(F.col("logits"), F.col("label")))
    bl = b.groupBy("epoch", "batch_id").agg(F.avg("nll").alias("loss"))
    return M.epoch_mean_loss(bl).select(F.col("epoch").cast("int"), r6(F.col("mean_loss")).alias("mean_loss"),
                                        "n_batches")
