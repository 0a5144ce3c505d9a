"""Model operators on Spark ML: shallow classifiers, weighted classifiers,
per-residue classifier, ridge regression to a vector, PCA, persistence.

The GPU fine-tuning of the source scripts is re-aimed at MLlib estimators
on encoder vectors; every fit and every score is a distributed Spark job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import FeatureHasher, IndexToString, PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import NO_VALUE, beside, lists_of, text_parts
from residuum.session import scratch_path


def _features(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(col)))


def train_shallow(df: DataFrame, features: str = "embedding", label: str = "class",
                  seed: int = 42, num_trees: int = 50, max_depth: int = 8,
                  kind: str = "forest") -> PipelineModel:
    """ML3: label indexer (alphabetical codes, as the label encoder) + trees on
    the vectors + code-to-label decoder.  ``kind='boosted'`` fits gradient
    boosted trees for two classes and one such model per class above."""
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                        handleInvalid="skip")
    d = _features(df, features)
    labels = idx.fit(d)
    if kind == "forest":
        trees = RandomForestClassifier(featuresCol="features", labelCol="label_idx", seed=seed,
                                       numTrees=num_trees, maxDepth=max_depth)
    elif kind == "boosted":
        trees = GBTClassifier(featuresCol="features", labelCol="label_idx", seed=seed,
                              maxIter=num_trees, maxDepth=min(max_depth, 5))
        if len(labels.labels) > 2:
            trees = OneVsRest(classifier=trees, featuresCol="features", labelCol="label_idx")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    fitted = Pipeline(stages=[labels, trees]).fit(d)
    dec = IndexToString(inputCol="prediction", outputCol="predicted_label",
                        labels=fitted.stages[0].labels)
    return PipelineModel(stages=[*fitted.stages, dec])


def score_shallow(model: PipelineModel, df: DataFrame, features: str = "embedding") -> DataFrame:
    """ML4: class code, class name and probability vector per row.

    Every row is scored, whatever its label column holds or lacks: the label
    indexer, which a fit needs and which skips null and unknown labels, takes
    no part in scoring."""
    stages = [s for s in model.stages if type(s).__name__ != "StringIndexerModel"]
    out = PipelineModel(stages=stages).transform(_features(df, features))
    if "probability" not in out.columns:  # one model per class: margins to shares
        share = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
        return (out.withColumn("prediction", F.col("prediction").cast("int"))
                   .withColumn("prediction_probability", F.transform(share, lambda x: x / total))
                   .drop("features", "rawPrediction"))
    return (out.withColumn("prediction", F.col("prediction").cast("int"))
               .withColumn("prediction_probability", vector_to_array(F.col("probability")))
               .drop("features", "rawPrediction", "probability"))


def save_model(model: PipelineModel, path: str) -> None:
    """SNK7: persist a fitted pipeline (shared file system path)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def weighted_classifier(df: DataFrame, weights: DataFrame, features: str = "embedding",
                        label: str = "code", class_col: str = "code", max_iter: int = 50
                        ) -> tuple:
    """ML5: multinomial logistic regression with balanced class weights
    (``weights``: one row per class)."""
    w = weights.select(F.col(class_col).alias("_c"), F.col("weight").alias("_w"))
    d = _features(df, features).join(w, F.col(label) == F.col("_c"), "left").fillna(0.0, ["_w"])
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w",
                            maxIter=max_iter, family="multinomial")
    return lr.fit(d.withColumn(label, F.col(label).cast("double")))


def residue_windows(df: DataFrame, id_col: str, seq_col: str, labels_col: str,
                    k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """ML6 input: one row per residue with its +-k neighbours as columns, and
    the ``keep`` columns of its record.

    The per-position structs are built on the row's own arrays first and
    only they are exploded, so no exploded row carries the whole sequence
    (which would cost O(length^2) per record)."""
    names = _context_names(k)
    # letters and length once per row; the lambda below only indexes them
    d = df.select(id_col, *keep, F.split(F.col(seq_col), "").alias("_ch"), labels_col,
                  F.length(seq_col).alias("_L"))
    L = F.col("_L")
    pos = F.when(L > 0, F.sequence(F.lit(1), L)).otherwise(F.array().cast("array<int>"))
    ctx = F.transform(pos, lambda i: F.struct(
        i.alias("pos"), F.element_at(F.col(labels_col), i).alias("label"),
        *[F.when((i + o >= 1) & (i + o <= L), F.element_at(F.col("_ch"), i + o))
          .otherwise(F.lit("_")).alias(name) for o, name in zip(range(-k, k + 1), names)]))
    e = d.select(id_col, *keep, F.explode(ctx).alias("_r"))
    return e.select(id_col, *keep, "_r.*")


HELD = 1 << 24  # residues whose contexts a task counts together
SLICE = 1 << 22  # residues cut into contexts at once


def counted_windows(df: DataFrame, seq_col: str, labels_col: str, k: int = 3,
                    keep: Sequence[str] = ()) -> DataFrame:
    """The rows of ``residue_windows`` without record and position, equal ones once with
    their number ``n``: every residue of every record is counted.

    A task counts the contexts of its own sequences in blocks of ``HELD`` residues, so
    what is shuffled grows with the variety of contexts and no row stands for one
    residue.  ``labels_col`` may be packed."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("label", T.IntegerType()),
                           T.StructField("_ctx", T.StringType()), T.StructField("n", T.LongType())])
    e = df.select(*keep, F.col(seq_col).alias("_seq"), F.col(labels_col).alias("_labels")) \
        .mapInArrow(_count_contexts(k, tuple(keep)), schema)
    per = e.groupBy(*keep, "label", "_ctx").agg(F.sum("n").alias("n"))
    return per.select(*keep, "label", *[F.substring("_ctx", i + 1, 1).alias(c) for i, c in enumerate(_context_names(k))], "n")


def _context_names(k: int) -> list[str]:
    return [f"c{o:+d}".replace("+", "p").replace("-", "m") for o in range(-k, k + 1)]


def _context_codes(seqs: pa.Array, labels: pa.Array, k: int):
    """One number per residue, of its label and the letters around it, 7 bits each and
    ``_`` beyond the ends; ``None`` if letters or labels do not fit."""
    offsets, data = text_parts(seqs)
    counts = np.diff(offsets)
    values = beside(counts, labels)
    known = values.is_valid().to_numpy(zero_copy_only=False)
    label = np.where(known, values.fill_null(0).to_numpy(zero_copy_only=False), NO_VALUE).astype(np.int64)
    if k > 3 or (data > 127).any() or (np.abs(label[known]) > 127).any():
        return None
    at = np.arange(len(data)) + k * (np.repeat(np.arange(len(counts)), counts) + 1)  # k letters between records
    line = np.full(len(data) + k * (len(counts) + 1), ord("_"), dtype=np.int64)
    line[at] = data
    code = np.zeros(len(line) - 2 * k, dtype=np.int64)
    for o in range(2 * k + 1):
        code <<= 7
        code |= line[o:len(code) + o]
    return (code[at - k] << 8) | (label - NO_VALUE)


def _counted_codes(code: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Labels, contexts and numbers of the distinct codes."""
    code, n = np.unique(code, return_counts=True)
    label = (code & 255) + NO_VALUE
    width = 2 * k + 1
    letters = np.empty((len(code), width), dtype=np.uint8)
    for o in range(width):
        letters[:, o] = (code >> (8 + 7 * (width - 1 - o))) & 127
    ends = np.arange(len(code) + 1, dtype=np.int32) * width
    ctx = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(ends), pa.py_buffer(letters.ravel())])
    return pa.array(label.astype(np.int32), mask=label == NO_VALUE), ctx, pa.array(n.astype(np.int64))


def _counted_letters(seqs: pa.Array, labels: pa.Array, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The same for any letters, labels and widths."""
    seen: Counter = Counter()
    for seq, row in zip(seqs.to_pylist(), lists_of(labels)):
        line = "_" * k + (seq or "") + "_" * k
        for i in range(len(line) - 2 * k):
            seen[row[i] if row is not None and i < len(row) else None, line[i:i + 2 * k + 1]] += 1
    return (pa.array([x for x, _ in seen], pa.int32()), pa.array([c for _, c in seen], pa.string()),
            pa.array(list(seen.values()), pa.int64()))


def _count_contexts(k: int, keep: tuple[str, ...]):
    """mapInArrow body: counted contexts of a task's rows, per value of ``keep``."""
    def rows(b: pa.RecordBatch, group: tuple, counted: tuple) -> Iterator[pa.RecordBatch]:
        label, ctx, n = counted
        same = [pa.repeat(pa.scalar(v, b.schema.field(c).type), len(n)) for c, v in zip(keep, group)]
        out = pa.RecordBatch.from_arrays([*same, label, ctx, n], names=[*keep, "label", "_ctx", "n"])
        for lo in range(0, len(n), 100_000):
            yield out.slice(lo, 100_000)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, b = {}, 0, None
        for b in batches:
            groups: dict[tuple, list[int]] = {}
            ends = np.cumsum(pc.binary_length(b["_seq"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
            values = zip(*(b[c].to_pylist() for c in keep)) if keep else [()] * len(b)
            for i, group in enumerate(values):
                groups.setdefault((group, ends[i]), []).append(i)
            for (group, _), at in groups.items():
                some = b.take(pa.array(at))
                code = _context_codes(some["_seq"], some["_labels"], k)
                if code is None:
                    yield from rows(b, group, _counted_letters(some["_seq"], some["_labels"], k))
                else:
                    held.setdefault(group, []).append(code)
                    size += len(code)
                if size >= HELD:
                    for g in list(held):
                        yield from rows(b, g, _counted_codes(np.concatenate(held.pop(g)), k))
                    size = 0
        for g in list(held):
            yield from rows(b, g, _counted_codes(np.concatenate(held.pop(g)), k))

    return fn


def context_columns(windows: DataFrame) -> list[str]:
    """The context columns of ``residue_windows``."""
    return [c for c in windows.columns if c.startswith("c")]


def context_counts(windows: DataFrame) -> DataFrame:
    """Distinct (context, label) of residue windows with their count ``n``.  Partial
    aggregates keep the distinct contexts of a task, so the fit's rows grow with the
    variety of contexts (at most 21^(2k+1) a label) and not with the residues.  Windows
    of ``counted_windows`` add up their counts."""
    n = F.sum("n") if "n" in windows.columns else F.count(F.lit(1))
    return windows.groupBy(*context_columns(windows), "label").agg(n.alias("n"))


def residue_classifier(windows: DataFrame, token_weights: DataFrame, num_features: int = 1 << 12,
                       max_iter: int = 20):
    """ML6: hashed context features + logistic regression weighted by the
    balanced residue-label weights (two rows: label 0 and 1).  The fit runs on
    the distinct contexts, counted once; a context's weight is its count times its label's."""
    ctx = context_columns(windows)
    hasher = FeatureHasher(inputCols=ctx, outputCol="features", numFeatures=num_features,
                           categoricalCols=ctx)
    w = F.broadcast(token_weights.select(F.col("label").alias("_l"), F.col("weight").alias("_w")))
    path = scratch_path(windows.sparkSession, "contexts")
    context_counts(windows).write.parquet(path)  # the fit reads its rows more than once
    counts = windows.sparkSession.read.parquet(path)
    d = counts.join(w, counts["label"] == w["_l"], "left").drop("_l").fillna(0.0, ["_w"]) \
        .withColumn("_w", F.col("_w") * F.col("n"))
    lr = LogisticRegression(featuresCol="features", labelCol="label_d", weightCol="_w",
                            maxIter=max_iter)
    pipe = Pipeline(stages=[hasher, lr])
    return pipe.fit(d.withColumn("label_d", F.col("label").cast("double")))


# ------------------------------------------------------------------ ridge


MERGE = 32  # partial sums merged by one task of a level


def _gram_partials(dx: int, dy: int):
    """mapInPandas body: per partition X'X and X'Y (X with an intercept column)."""
    def fn(batches):
        xtx, xty, n = np.zeros((dx + 1, dx + 1)), np.zeros((dx + 1, dy)), 0
        for b in batches:
            if len(b):
                X = np.vstack(b["x"].to_numpy())
                X = np.hstack([X, np.ones((len(X), 1))])
                xtx += X.T @ X
                xty += X.T @ np.vstack(b["y"].to_numpy())
                n += len(X)
        if n:
            yield pd.DataFrame({"n": [n], "xtx": [xtx.ravel()], "xty": [xty.ravel()]})
    return fn


def _add_partials(batches):
    """mapInPandas body: one row with the sums of the partition's partials."""
    total = None
    for b in batches:
        for row in b.itertuples(index=False):
            total = list(row) if total is None else [a + x for a, x in zip(total, row)]
    if total is not None:
        yield pd.DataFrame({"n": [total[0]], "xtx": [total[1]], "xty": [total[2]]})


def _vector(df: DataFrame, col: str):
    """A column as array<double>; a scalar becomes a vector of one value."""
    if isinstance(df.schema[col].dataType, T.ArrayType):
        return F.col(col).cast("array<double>")
    return F.array(F.col(col).cast("double"))


def gram_sums(df: DataFrame, x_col: str, y_col: str, dx: int, dy: int) -> tuple:
    """``(rows, X'X, X'Y)``: one partial per task, merged in a tree, so at most
    ``MERGE`` rows of (dx + 1) * (dx + 1 + dy) numbers reach the driver."""
    schema = "n bigint, xtx array<double>, xty array<double>"
    src = df.select(_vector(df, x_col).alias("x"), _vector(df, y_col).alias("y"))
    parts, tasks = src.mapInPandas(_gram_partials(dx, dy), schema), src.rdd.getNumPartitions()
    while tasks > MERGE:
        tasks = -(-tasks // MERGE)
        parts = parts.repartition(tasks).mapInPandas(_add_partials, schema)
    n, xtx, xty = 0, np.zeros((dx + 1) ** 2), np.zeros((dx + 1) * dy)
    for r in parts.collect():
        n, xtx, xty = n + r["n"], xtx + np.array(r["xtx"]), xty + np.array(r["xty"])
    return n, xtx.reshape(dx + 1, dx + 1), xty.reshape(dx + 1, dy)


def fit_ridge(df: DataFrame, x_col: str, y_col: str, dx: int, dy: int = 1, alpha: float = 1.0
              ) -> np.ndarray:
    """ML7 fit: sums of X'X and X'Y over all rows, then a (dx+1)^2 solve on the
    driver; the intercept is not penalised.  ``y_col`` is a vector of ``dy``
    values or a scalar."""
    _, xtx, xty = gram_sums(df, x_col, y_col, dx, dy)
    reg = alpha * np.eye(dx + 1)
    reg[dx, dx] = 0.0
    return _solve(xtx + reg, xty)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivoting, element-wise numpy only: the threaded
    BLAS behind ``numpy.linalg.solve`` deadlocks in a driver next to the JVM
    gateway threads (observed)."""
    m = np.hstack([a, b]).astype(np.float64)
    n = len(a)
    for k in range(n):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        other = m[:, k].copy()
        other[k] = 0.0
        m -= np.multiply.outer(other, m[k])
    return m[:, n:]


def ridge_residual(df: DataFrame, coef: np.ndarray, x_col: str, y_col: str, alpha: float = 1.0) -> float:
    """Largest violation of the normal equations, relative to X'Y."""
    dx, dy = coef.shape[0] - 1, coef.shape[1]
    _, xtx, xty = gram_sums(df, x_col, y_col, dx, dy)
    penalty = alpha * coef
    penalty[dx] = 0.0
    return float(np.abs(np.einsum("ij,jk->ik", xtx, coef) + penalty - xty).max() / max(1.0, np.abs(xty).max()))


def predict_ridge(df: DataFrame, coef: np.ndarray, x_col: str, out: str = "prediction"
                  ) -> DataFrame:
    """ML7 score: X @ B per Arrow batch; B (d x D) travels in the closure."""
    B = coef

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _pred(x: pd.Series) -> pd.Series:
        X = np.vstack(x.to_numpy())
        X = np.hstack([X, np.ones((len(X), 1))])
        return pd.Series(list(X @ B))  # one BLAS thread per worker (session env)

    return df.withColumn(out, _pred(F.col(x_col)))


def pca(df: DataFrame, features: str = "embedding", k: int = 5):
    """ML8: centred PCA (MLlib's PCA does not centre, so scale with the mean
    first); returns (projected frame with ``pcs``, explained variance)."""
    d = _features(df, features)
    sc = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    p = PCA(k=k, inputCol="centred", outputCol="pcs_v")
    m = Pipeline(stages=[sc, p]).fit(d)
    out = m.transform(d).withColumn("pcs", vector_to_array("pcs_v")).drop(
        "features", "centred", "pcs_v")
    return out, m.stages[-1].explainedVariance.toArray()
