"""Packed labels and tokens, and windows counted in their tasks, against the plain forms."""

import array
import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from residuum.functions import digests
from residuum.functions.residues import residue_letters, residue_only
from residuum.operators import annotate, balance, models, tokens
from residuum.operators import metrics as M


def _plain(rows, k):
    """Counted windows in plain Python: rows are (split, seq, labels)."""
    out = Counter()
    for split, seq, labels in rows:
        line = "_" * k + (seq or "") + "_" * k
        for i in range(len(seq or "")):
            label = labels[i] if labels is not None and i < len(labels) else None
            out[split, label, line[i:i + 2 * k + 1]] += 1
    return out


def _counted(df, k):
    got = models.counted_windows(df, "seq", "labels", k, keep=["split"])
    assert got.columns[2:-1] == models.context_columns(models.residue_windows(df, "split", "seq", "labels", k))
    out = Counter()
    for r in got.collect():
        assert (r.split, r.label, "".join(r[2:-1])) not in out
        out[r.split, r.label, "".join(r[2:-1])] = r.n
    return out


def test_counted_windows_are_the_windows_counted(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["train", "test", None]), "".join(rng.choice("ACK_") for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    rows = [(p, s, [rng.randint(0, 1) for _ in s]) for p, s in rows] + [("test", None, [1]), ("test", "AC", [None, 1]), ("train", "", [])]
    df = spark.createDataFrame(rows, "split string, seq string, labels array<int>").repartition(3)
    for k in (1, 3, 5):
        assert _counted(df, k) == _plain(rows, k)
    each = models.residue_windows(df, "split", "seq", "labels", 2)
    same = each.groupBy("split", "label", *models.context_columns(each)).count().collect()
    assert _counted(df, 2) == Counter({(r[0], r[1], "".join(r[2:-1])): r[-1] for r in same})
    # no row of the plan stands for one residue
    plan = models.counted_windows(df, "seq", "labels", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_counted_windows_of_odd_letters_and_labels(spark):
    rows = [("a", "Aé界C", [1, 0, 300, None]), ("a", "AC", [1]), ("b", "ACAC", None), ("b", "K" * 50, [0] * 60)]
    df = spark.createDataFrame(rows, "split string, seq string, labels array<int>").repartition(1)
    for k in (0, 3):
        assert _counted(df, k) == _plain(rows, k)


def test_context_counts_in_small_blocks(monkeypatch):
    monkeypatch.setattr(models, "HELD", 50)
    monkeypatch.setattr(models, "SLICE", 20)
    rng = random.Random(5)
    rows = [(rng.choice("xy"), "".join(rng.choice("AC") for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    rows = [(p, s, [int(c == "A") for c in s]) for p, s in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([r[1] for r in some]),
                                           pa.array([bytes(r[2]) for r in some], pa.binary())], names=["split", "_seq", "_labels"])
               for some in (rows[:25], rows[25:])]
    got = Counter()
    for b in models._count_contexts(2, ("split",))(iter(batches)):
        for r in b.to_pylist():
            got[r["split"], r["label"], r["_ctx"]] += r["n"]
    assert got == _plain(rows, 2)


def test_packed_masks_and_their_weights(spark):
    rows = [("ACDEF", [1, 5, 9, 0]), ("", [1]), (None, [1]), ("AC", [])]
    odd = [("AC", None), ("ACD", [2, None])]

    def values(rows):
        df = spark.createDataFrame(rows, "seq string, pos array<int>").repartition(1)
        return df.select(annotate.ptm_mask(F.col("seq"), F.col("pos")).alias("plain"),
                         annotate.ptm_mask(F.col("seq"), F.col("pos"), packed=True).alias("packed"))

    for r in values(rows + odd).collect():
        assert [None if x == 128 else x for x in r.packed] == r.plain
    for some in (rows, rows + odd):
        v = values(some)
        assert balance.token_class_weights(v, "packed").collect() == balance.token_class_weights(v, "plain").collect()


def _pack(rows):
    return None if rows is None else bytes((-128 if x is None else x) & 255 for x in rows)


def _unpack(data, kind="b"):
    return None if data is None else [None if x == -128 or x != x else x for x in memoryview(data).cast(kind).tolist()]


IDS = [("a", [0, *[4 + i % 20 for i in range(1500)], 2]), (None, [0, 5, 2]), ("b", None), ("c", []), ("d", [None, 7, 1, 8] * 9), ("k" * 70, [9] * 40)]


def test_digests_of_positions_in_one_and_two_blocks():
    keys = ["1", *["k" * n for n in (44, 47, 50, 51, 52, 53, 60, 61, 124, 200)], "é", "", "12345"]
    counts = np.array([1200, 120, 11, 1500, 150, 12, 11, 101, 0, 12, 3, 7, 0, digests.TABLE + 500])
    want = [hashlib.md5(f"42:{k}:{i}".encode()).hexdigest() for k, c in zip(keys, counts) for i in range(c)]
    for n in (4, 1):
        w = digests.position_words(42, keys, counts, n)
        assert ["".join(f"{x:08x}" for x in col) for col in w.T.tolist()] == [h[:8 * n] for h in want]


def test_slices_of_a_batch_are_its_rows(monkeypatch):
    monkeypatch.setattr(digests, "SLICE", 8)
    lists = pa.array([r for _, r in IDS] * 3, pa.list_(pa.int32()))
    keys = pa.array([k for k, _ in IDS] * 3)
    seen = []

    @digests.in_slices
    def same(a, b):
        assert len(a) == len(b)
        seen.append(len(a))
        counts, values = digests.list_parts(a)
        return digests.list_like(a, counts, values)

    for a in (lists, pa.array([_pack(r) for _, r in IDS] * 3, pa.binary()), lists.slice(3, 0)):
        assert same(a, keys.slice(0, len(a))).to_pylist() == a.to_pylist()
    assert len(seen) > 10


def test_packed_sequences_and_tokens(spark):
    df = spark.createDataFrame([("LAé界xX-b o\nw",), ("",), (None,), ("😀kK",), ("ac" * 700,)], "t string").repartition(1)
    for r in df.select(residue_only(F.col("t")).alias("a"), residue_letters(F.col("t")).alias("b")).collect():
        assert r.a == r.b
    for special in (True, False):
        for longest in (None, 3):
            got = df.select(tokens.tokenize_residues(F.col("t"), longest, special).alias("a"),
                            tokens.tokenize_residues(F.col("t"), longest, special, packed=True).alias("b")).collect()
            assert all(_unpack(r.b) == r.a for r in got)


def test_packed_token_accuracy(spark):
    rows = [([-100, 5, 6, None], [1, 5, 7, 2]), ([5, 6], [5]), (None, [1]), ([7], None), ([], []), ([8, -100], [8, 8, 8])]
    plain = spark.createDataFrame(rows, "labels array<int>, preds array<int>")
    packed = spark.createDataFrame([tuple(map(_pack, r)) for r in rows], "labels binary, preds binary").repartition(1)
    assert M.masked_token_accuracy(packed).collect() == M.masked_token_accuracy(plain).collect()


def test_packed_masks_and_their_digests(spark):
    plain = spark.createDataFrame(IDS, "record_id string, input_ids array<int>").repartition(1)
    packed = spark.createDataFrame([(k, _pack(r)) for k, r in IDS], "record_id string, input_ids binary").repartition(1)

    def joined(c):
        return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))

    for copy in (False, True):
        a, b = tokens.mlm_mask(plain, ignore_others=not copy), tokens.mlm_mask(packed, ignore_others=not copy)
        want = {r.record_id: (r.labels, r.input_ids) for r in a.collect()}
        assert {r.record_id: (_unpack(r.labels), _unpack(r.input_ids)) for r in b.collect()} == want
        want = a.select("record_id", F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n"),
                        joined("labels").alias("x"), joined("input_ids").alias("y"))
        got = b.select("record_id", tokens.n_targets(F.col("labels")), tokens.ids_md5(F.col("labels")), tokens.ids_md5(F.col("input_ids")))
        want = {tuple(r) if r.x is not None else (r.record_id, None, None, None) for r in want.collect()}
        assert set(map(tuple, got.collect())) == want


def test_packed_perplexity(spark):
    rows = [([-100, 5, 6, None], [.1, .5, .25, .2]), ([5, 6], [.5]), (None, [.5]), ([7], None), ([], []), ([8, -100], [0.0, .5, .5]), ([9], [None])]
    plain = spark.createDataFrame(rows, "labels array<int>, p_true array<double>")
    packed = spark.createDataFrame([(_pack(a), None if p is None else array.array("d", [math.nan if x is None else x for x in p]).tobytes())
                                    for a, p in rows], "labels binary, p_true binary").repartition(1)
    a, b = M.perplexity(plain).first(), M.perplexity(packed).first()
    assert a.n_scored == b.n_scored and math.isclose(a.mean_ce, b.mean_ce) and math.isclose(a.perplexity, b.perplexity)


def test_packed_pairs_without_ignored(spark):
    rows = [([-100, 5, 6, None], [1, 5, 7, 2]), ([5, 6], [5]), (None, [1]), ([7], None), ([], []), ([8, -100], [8, None, 8]), ([-100], [3])]
    plain = spark.createDataFrame(rows, "a array<int>, b array<int>")
    packed = spark.createDataFrame([tuple(map(_pack, r)) for r in rows], "a binary, b binary").repartition(1)
    want = sorted(map(str, plain.select(tokens.ignore_index(F.col("a"), F.col("b")).alias("k")).collect()))
    assert sorted(map(str, packed.select(tokens.ignore_index(F.col("a"), F.col("b"), packed=True).alias("k")).collect())) == want


def test_digests_of_many_short_blocks(monkeypatch):
    monkeypatch.setattr(digests, "BLOCK", 50)
    keys = ["7", "12", "k" * 55, "", "34", "k" * 70, "8"]
    counts = np.array([49, 160, 30, 0, 1, 75, 1020])
    want = [hashlib.md5(f"s:{k}:{i}".encode()).hexdigest() for k, c in zip(keys, counts) for i in range(c)]
    for n in (4, 1):
        w = digests.position_words("s", keys, counts, n)
        assert ["".join(f"{x:08x}" for x in col) for col in w.T.tolist()] == [h[:8 * n] for h in want]


def test_a_block_of_digests_is_made_in_its_space():
    n = 40_000
    space = digests._space(n)[:, :n]
    assert all(row.ctypes.data % 64 == 0 for row in space)
    words = [np.arange(n, dtype=np.uint32), 5, *[0] * 14]
    tracemalloc.start()
    try:
        got = digests._compress([*digests._START], words, 64, space)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 5 * 4 * n  # the four words of the result, nothing for the work
    for i in (0, 1, n - 1):
        one = digests._compress([np.array([s], dtype=np.uint32) for s in digests._START], [np.array([i], dtype=np.uint32), *words[1:]])
        assert [int(x[i]) for x in got] == [int(x[0]) for x in one]


def test_digests_of_all_packed_values(spark):
    rows = [list(range(-127, 128)), [], [None], [None, 5, None], [-100] * 700, None, [0], [127, None, -127]]
    df = spark.createDataFrame([(k, _pack(r)) for k, r in enumerate(rows)], "k int, ids binary").repartition(1)
    got = {r.k: r.h for r in df.select("k", tokens.ids_md5(F.col("ids")).alias("h")).collect()}
    assert got == {k: None if r is None else hashlib.md5(",".join(str(x) for x in r if x is not None).encode()).hexdigest()
                   for k, r in enumerate(rows)}


def test_dual_task_loss_of_own_rows(spark, tmp_path):
    from residuum.plans.q_metrics import q_dual_task_loss
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACDxé kY") for _ in range(rng.randint(0, 900))) for _ in range(40)] + [None, "", "b" * 30]
    rows = [(10 ** (k % 7) + k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)] + [(None, "ACD" * 30, None, None, None)]
    vectors = [(k, [rng.random() for _ in range(4)], k % 3) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def drawn(seed, key, i):
        return int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:8], 16)

    nll = [-math.log(0.05 + 0.9 * drawn("42-p", key, i) / 2**32) for key, t, *_ in rows if key is not None
           for i in range(1, 1 + sum(c in "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy" for c in t or "")) if drawn(42, key, i) < 0x26666666]
    errors = [(y - (y * 0.9 + k % 5 * 0.01)) ** 2 for k, v, _ in vectors for y in v]
    got = q_dual_task_loss(spark, str(tmp_path)).first()
    assert math.isclose(got.ce, sum(nll) / len(nll), abs_tol=2e-6)
    assert math.isclose(got.mse, sum(errors) / len(errors), abs_tol=2e-6) and math.isclose(got.loss, 100 * sum(errors) / len(errors), abs_tol=2e-4)
