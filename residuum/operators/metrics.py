"""Evaluation metrics as aggregates.

Classification metrics all read one confusion table ``(y, p, n)`` built by
a single partial aggregate over the predictions (at most k^2 rows), so the
prediction set is scanned once whatever the number of metrics.  Token metrics sum
per-row counts that numpy takes from Arrow batches; vector metrics sum per-row
array aggregates (``aggregate`` / ``zip_with``) and only explode fixed-width vectors, which partial aggregation collapses
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.functions.digests import beside, in_slices, list_parts
from residuum.functions.residues import IGNORE_LABEL


# ------------------------------------------------------------ row functions


def _dbl(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def argmax(logits: Column) -> Column:
    """PRJ17: 0-based index of the largest value (first on ties)."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def logsumexp(logits: Column) -> Column:
    l = _dbl(logits)
    m = F.array_max(l)
    return m + F.log(F.aggregate(l, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def softmax(logits: Column) -> Column:
    """PRJ18: normalised exponentials, max-shifted for stability."""
    l = _dbl(logits)
    m = F.array_max(l)
    e = F.transform(l, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def threshold_label(p1: Column, threshold: float = 0.9) -> Column:
    """PRJ19: 1 if P(class 1) >= threshold."""
    return F.when(p1 >= F.lit(threshold), 1).otherwise(0)


def nll(logits: Column, label: Column) -> Column:
    """Cross-entropy of one row: logsumexp(logits) - logits[label]."""
    return logsumexp(logits) - F.element_at(_dbl(logits), label + 1)


def row_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one row; null where one of them is zero."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    a, b = _dbl(a), _dbl(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def row_r2(pred: Column, target: Column, truth: str = "pred") -> Column:
    """AGG20: R^2 of two vectors of one row.

    ``truth='pred'`` reproduces the search fitness, which passes the
    prediction as the true values; ``truth='target'`` is the usual R^2.
    """
    y, yh = (_dbl(pred), _dbl(target)) if truth == "pred" else (_dbl(target), _dbl(pred))
    mean = F.aggregate(y, F.lit(0.0), lambda a, x: a + x) / F.size(y)
    sse = F.aggregate(F.zip_with(y, yh, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                      lambda a, x: a + x)
    sst = F.aggregate(y, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.lit(1.0) - F.try_divide(sse, sst)


# -------------------------------------------------------- confusion table


def confusion_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``(y, p, n)`` counts; the only pass over the predictions."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame) -> DataFrame:
    """Per class: tp, predicted, true, precision, recall, f1 (0 if undefined).
    Every cell counts once for its true and once for its predicted class."""
    none = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none)
    both = F.array(F.struct(F.col("y").alias("c"), hit.alias("tp"), none.alias("n_pred"), F.col("n").alias("support")),
                   F.struct(F.col("p").alias("c"), none.alias("tp"), F.col("n").alias("n_pred"), none.alias("support")))
    t = cm.select(F.inline(both)).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "n_pred", "support")])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def accuracy(cm: DataFrame) -> DataFrame:
    """AGG7."""
    return cm.agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
                   / F.sum("n")).alias("accuracy"))


def weighted_prf(cm: DataFrame) -> DataFrame:
    """AGG8: support-weighted precision, recall, F1."""
    t = per_class(cm)
    s = F.sum("support")
    return t.agg((F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"))


def balanced_accuracy(cm: DataFrame) -> DataFrame:
    """AGG13: mean recall over the classes that occur as truth."""
    t = per_class(cm).where(F.col("support") > 0)
    return t.agg(F.avg("recall").alias("balanced_accuracy"))


def binary_counts(cm: DataFrame, positive=1) -> DataFrame:
    """TN, FP, FN, TP of a two-class confusion table."""
    pos = F.lit(positive)

    def cell(yp, pp):
        return F.sum(F.when(yp & pp, F.col("n")).otherwise(0)).cast("long")
    return cm.agg(cell(F.col("y") != pos, F.col("p") != pos).alias("tn"),
                  cell(F.col("y") != pos, F.col("p") == pos).alias("fp"),
                  cell(F.col("y") == pos, F.col("p") != pos).alias("fn"),
                  cell(F.col("y") == pos, F.col("p") == pos).alias("tp"))


def binary_metrics(cm: DataFrame, positive=1) -> DataFrame:
    """AGG9-AGG11: precision, recall, F1 of the positive class, ROC AUC of
    hard predictions ((TPR + TNR) / 2, null with one class only) and MCC
    (0 when undefined)."""
    b = binary_counts(cm, positive)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    auc = F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))
    return b.select("tn", "fp", "fn", "tp", prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"), auc.alias("roc_auc"), mcc.alias("mcc"))


def confusion_matrix(cm: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """AGG12: the cells ``(true, predicted, n)`` that occur; with a list of
    ``classes`` every cell over them, zeros included (k^2 literals that the
    caller asks for)."""
    seen = cm.groupBy("y", "p").agg(F.sum("n").cast("long").alias("n"))
    if classes is None:
        return seen
    listed = F.array(*[F.lit(c) for c in classes])
    one = cm.sparkSession.range(1).select(F.explode(listed).alias("y"))
    grid = one.select("y", F.explode(listed).alias("p"))
    return grid.join(seen, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(cm: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """AGG14: per class precision, recall, F1, support, then the
    ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    t = per_class(cm)
    if names is not None:
        t = t.join(names.select(F.col("code").alias("c"), F.col("name")), "c", "left")
        label = F.coalesce(F.col("name"), F.col("c").cast("string"))
    else:
        label = F.col("c").cast("string")
    # each class row counts for itself and for the three summary rows
    support, zero = F.col("support"), F.lit(0.0)
    kinds = F.array(*[F.struct(name.alias("label"), F.lit(kind).alias("kind")) for name, kind in (
        (label, 0), (F.lit("accuracy"), 1), (F.lit("macro avg"), 2), (F.lit("weighted avg"), 3))])
    each = t.select("precision", "recall", "f1", "tp", "support", F.inline(kinds))
    weight = F.when(F.col("kind") == 3, support).otherwise(F.lit(1))

    def mean(c):
        return F.when(F.col("kind") != 1, F.sum(F.col(c) * weight) / F.sum(weight))

    return each.groupBy("label", "kind").agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"),
        F.coalesce(mean("f1"), F.sum("tp") / F.sum("support"), zero).alias("f1"),
        F.sum("support").cast("long").alias("support")).drop("kind")


# ------------------------------------------------------------ token metrics


def _scored(labels: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Rows that have both arrays; then per label its row, the label, and whether it counts
    (not -100, in a row that has both)."""
    counts, values = list_parts(labels)
    row = np.repeat(np.arange(len(labels)), counts)
    both = (labels.is_valid().to_numpy(zero_copy_only=False) & other.is_valid().to_numpy(zero_copy_only=False))
    real = pc.not_equal(values, pa.scalar(IGNORE_LABEL, values.type)).fill_null(False).to_numpy(zero_copy_only=False)
    return both, row, values, real & both[row]


def masked_token_accuracy(df: DataFrame, labels: str = "labels", preds: str = "preds"
                          ) -> DataFrame:
    """AGG15: correct / scored over positions whose label is not -100
    (a ratio of sums, not a mean of per-row ratios).  Both may be packed."""
    @F.arrow_udf("struct<correct: bigint, scored: bigint>")
    @in_slices
    def _hits(labels: pa.Array, preds: pa.Array) -> pa.Array:
        both, row, values, scored = _scored(labels, preds)
        hit = pc.equal(values, beside(list_parts(labels)[0], preds)).fill_null(False).to_numpy(zero_copy_only=False)
        sums = [pa.array(np.bincount(row[m], minlength=len(labels)), mask=~both) for m in (scored & hit, scored)]
        return pa.StructArray.from_arrays(sums, names=["correct", "scored"])

    return df.select(_hits.asNondeterministic()(labels, preds).alias("_n")).agg(
        F.sum("_n.correct").cast("long").alias("n_correct"), F.sum("_n.scored").cast("long").alias("n_scored")
    ).withColumn("accuracy", F.col("n_correct") / F.col("n_scored"))


def perplexity(df: DataFrame, labels: str = "labels", p_true: str = "p_true") -> DataFrame:
    """AGG16: mean cross-entropy over non-ignored positions, and its exp.

    ``p_true`` holds, per position, the model probability of the true token; it may
    be packed doubles, as ``labels`` may be packed.
    """
    @F.arrow_udf("struct<nll: double, scored: bigint>")
    @in_slices
    def _nll(labels: pa.Array, p_true: pa.Array) -> pa.Array:
        both, row, _, scored = _scored(labels, p_true)
        row, q = row[scored], beside(list_parts(labels)[0], p_true, np.float64).filter(pa.array(scored))
        q = q.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        known = both & (np.bincount(row[q <= 0], minlength=len(labels)) == 0)  # no logarithm: no sum
        nll = np.bincount(row, -np.log(np.where(q <= 0, 1.0, q)), minlength=len(labels))
        n = np.bincount(row, minlength=len(labels))
        return pa.StructArray.from_arrays([pa.array(nll, mask=~known), pa.array(n, mask=~both)], names=["nll", "scored"])

    tot = df.select(_nll.asNondeterministic()(labels, p_true).alias("_n")).agg(
        F.sum("_n.nll").alias("sum_nll"), F.sum("_n.scored").cast("long").alias("n_scored"))
    return tot.select("n_scored", (F.col("sum_nll") / F.col("n_scored")).alias("mean_ce"),
                      F.exp(F.col("sum_nll") / F.col("n_scored")).alias("perplexity"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, logits: str = "logits",
                           label: str = "label", class_col: str = "class") -> DataFrame:
    """AGG17: sum(w[y] * nll) / sum(w[y]); ``weights`` is (class, weight)."""
    w = weights.select(F.col(class_col).alias("_c"), F.col("weight"))
    j = df.join(w, df[label] == w["_c"], "left").fillna(0.0, ["weight"])
    return j.agg((F.sum(F.col("weight") * nll(F.col(logits), F.col(label))) /
                  F.sum("weight")).alias("weighted_ce"),
                 F.avg(nll(F.col(logits), F.col(label))).alias("mean_ce"))


# ----------------------------------------------------------- vector metrics


def per_dim(df: DataFrame, y: str, p: str) -> DataFrame:
    """(dim, y, p) rows; vectors are fixed width, so partial aggregation
    after this explode keeps one row per dim per task."""
    return df.select(F.posexplode(F.arrays_zip(_dbl(F.col(y)).alias("y"),
                                               _dbl(F.col(p)).alias("p"))).alias("dim", "v")
                     ).select("dim", F.col("v.y").alias("y"), F.col("v.p").alias("p"))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AGG18: MSE, RMSE, R^2 per output dimension, then the plain mean over
    dimensions (RMSE averages the per-dimension roots).  One pass: the
    centred sum of squares is the population variance times the count."""
    error = (F.col("y") - F.col("p")) ** 2
    per = per_dim(df, y, p).groupBy("dim").agg(
        F.avg(error).alias("mse"), F.sum(error).alias("sse"),
        (F.var_pop("y") * F.count("y")).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return per.agg(F.avg("mse").alias("mse"), F.avg(F.sqrt("mse")).alias("rmse"),
                   F.avg(r2).alias("r2"))


def pooled_r2(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AGG19: one R^2 over all values of all rows (one pass)."""
    return per_dim(df, y, p).agg(
        (1 - F.sum((F.col("y") - F.col("p")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2"))


def dual_task_loss(ce: Column, mse: Column, w_mlm: float = 0.0, w_reg: float = 100.0) -> Column:
    """AGG21: w_mlm * CE + w_reg * MSE (plain factors)."""
    return F.lit(w_mlm) * ce + F.lit(w_reg) * mse


def epoch_mean_loss(batch_losses: DataFrame, epoch: str = "epoch", loss: str = "loss"
                    ) -> DataFrame:
    """AGG22: mean of the batch losses of each epoch."""
    return batch_losses.groupBy(epoch).agg(F.avg(loss).alias("mean_loss"),
                                           F.count(F.lit(1)).alias("n_batches"))


def population_stats(pop: DataFrame, group_cols=("generation", "candidate_id"),
                     fitness: str = "fitness") -> DataFrame:
    """AGG23: avg / min / max fitness per generation (and candidate)."""
    return pop.groupBy(*group_cols).agg(F.avg(fitness).alias("avg"), F.min(fitness).alias("min"),
                                        F.max(fitness).alias("max"))


__all__ = ["accuracy", "argmax", "balanced_accuracy", "binary_counts", "binary_metrics",
           "classification_report", "confusion_matrix", "confusion_table", "dual_task_loss",
           "epoch_mean_loss", "logsumexp", "masked_token_accuracy", "nll", "per_class", "per_dim", "perplexity",
           "pooled_r2", "population_stats", "regression_metrics", "row_r2", "softmax",
           "threshold_label", "weighted_cross_entropy", "weighted_prf"]
