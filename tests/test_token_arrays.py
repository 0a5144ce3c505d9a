"""Masks, tokens and token metrics on odd arrays, against plain Python."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from residuum.functions import digests
from residuum.operators import metrics as M
from residuum.operators import tokens


def _hex(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def test_position_words_are_the_digests():
    keys = ["1", "k" * 44, "k" * 47, "k" * 60, "k" * 200, "é", ""]
    counts = np.array([1200, 120, 11, 12, 101, 0, 3])
    w = digests.position_words(42, keys, counts)
    want = [_hex(42, k, i) for k, c in zip(keys, counts) for i in range(c)]
    assert ["".join(f"{int(x):08x}" for x in w[:, j]) for j in range(w.shape[1])] == want
    for prefix in ("26666666", "8", "266666660a"):
        assert digests.below(w, prefix).tolist() == [h < prefix for h in want]


def test_beside_fills_shorter_arrays():
    other = pa.array([[1], None, [2, 3, 4], []], pa.list_(pa.int32()))
    assert digests.beside(np.array([2, 1, 2, 0]), other).to_pylist() == [1, None, None, 2, 3]


def test_mlm_mask_of_odd_rows(spark):
    long = [4 + i % 20 for i in range(1500)]
    rows = [("a", [0, *long, 2]), (None, [0, 5, 2]), ("b", None), ("c", []), ("d", [None, 7, 1, 8] * 9), ("k" * 70, [9] * 40)]
    df = spark.createDataFrame(rows, "record_id string, input_ids array<int>").repartition(1)

    def one(key, ids, copy):
        if ids is None:
            return None, None
        labels, out = [], []
        for i, t in enumerate(ids):
            h = _hex(42, key, i) if key is not None else "f"
            hit = t not in (None, 0, 1, 2) and h < "26666666"
            labels.append(t if hit or copy else -100)
            out.append(t if not hit or h[8:16] >= "e6666666" else 32 if h[8:16] < "cccccccc" else int(h[16:24], 16) % 33)
        return labels, out

    for copy in (False, True):
        got = [(r.record_id, r.labels, r.input_ids) for r in tokens.mlm_mask(df, ignore_others=not copy).collect()]
        assert sorted(got, key=str) == sorted([(k, *one(k, ids, copy)) for k, ids in rows], key=str)


def test_tokens_of_odd_letters(spark):
    df = spark.createDataFrame([("LAé界X-",), ("",), (None,), ("😀K",)], "seq string").repartition(1)
    got = {r.seq: (r.ids, r.cut) for r in df.select("seq", tokens.tokenize_residues(F.col("seq"), None, True).alias("ids"),
                                                    tokens.tokenize_residues(F.col("seq"), 3).alias("cut")).collect()}
    assert got == {"LAé界X-": ([0, 4, 5, 3, 3, 24, 30, 2], [4, 5, 3]), "": ([0, 2], []), None: ([0, 2], []), "😀K": ([0, 3, 15, 2], [3, 15])}


def test_token_metrics_of_odd_rows(spark):
    df = spark.createDataFrame([([-100, 5, 6, None], [1, 5, 7, 2], [.1, .5, .25, .2]), ([5, 6], [5], [.5]), (None, [1], [.5]),
                                ([7], None, None), ([], [], []), ([8, -100], [8, 8, 8], [0.0, .5, .5])],
                               "labels array<int>, preds array<int>, p_true array<double>")
    a = M.masked_token_accuracy(df).first()
    assert (a.n_correct, a.n_scored) == (3, 5)
    p = M.perplexity(df).first()
    # rows with an unknown probability have no sum, but count
    assert p.n_scored == 5 and math.isclose(p.mean_ce, -math.log(.5 * .25) / 5)
