"""Small exact cases worked out by hand (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from residuum.functions.hashing import hash_bucket
from residuum.operators import annotate, balance, curate, embed, evolve, metrics as M, split
from residuum.operators.chunk import chunk_sequence
from residuum.operators.ranking import ordered_cumsum, prefix_select
from residuum.sources import fasta, tables
from residuum.session import scratch_path
from residuum.sinks import writers

CAS = [f"cas{i}" for i in range(1, 14)]


def test_fasta_parse(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_bytes(b">r1 cas1 CR=1 x > y\r\nMKT\r\nAYI\r\n>r2 d\nACDE\n")
    got = {(r.record_id, r.description, r.seq) for r in fasta.read_fasta(spark, str(p)).collect()}
    assert got == {("r1", "r1 cas1 CR=1 x > y", "MKTAYI"), ("r2", "r2 d", "ACDE")}


def test_keyword_label(spark):
    df = spark.createDataFrame([("CRISPR Cas13 x",), ("Cas12a",), ("nope",), ("cas9 and cas3",)], "h string")
    got = [r[0] for r in df.select(annotate.keyword_label(F.col("h"), CAS)).collect()]
    assert got == ["cas13", "cas12", "", "cas9"]


def test_mod_res_mask_chunks_and_rejects(spark):
    df = spark.createDataFrame([("a", "MKTAYIAK", 'MOD_RES 2; /note="x"; MOD_RES 5..6'),
                                ("b", "MKTAYIAK", "MOD_RES 99"), ("c", "MKTAYIAK", "MOD_RES 0"),
                                ("d", "MKTAYIAK", None), ("e", "", "MOD_RES 1")],
                               "id string, seq string, m string")
    d = df.withColumn("pos", annotate.mod_res_positions(F.col("m"))).withColumn(
        "labels", annotate.ptm_mask(F.col("seq"), F.col("pos")))
    rows = {r.id: r for r in d.collect()}
    assert rows["a"].pos == [2, 5]
    assert rows["a"].labels == [0, 1, 0, 0, 1, 0, 0, 0]
    assert rows["b"].labels == [0] * 8 and rows["c"].labels == [0] * 8
    assert rows["d"].pos == [] and rows["d"].labels == [0] * 8
    rej = annotate.ptm_rejects(d, "id", "seq", "pos").collect()
    assert sorted((r.id, r.position) for r in rej) == [("b", 99), ("c", 0), ("e", 1)]
    ch = chunk_sequence(d.where("id = 'a' or id = 'e'").select("id", "seq", "labels"), 3, "seq", "labels")
    got = sorted((r.id, r.chunk_id, r.seq, r.labels) for r in ch.collect())
    assert got == [("a", 0, "MKT", [0, 1, 0]), ("a", 1, "AYI", [0, 1, 0]), ("a", 2, "AK", [0, 0])]


def test_class_code(spark):
    df = spark.createDataFrame([("cas2",), ("cas10",), ("cas1",), (None,)], "class string")
    got = [r.code for r in annotate.class_code(df).orderBy(F.col("class").asc_nulls_last()).collect()]
    # order by class: cas1, cas10, cas2, null
    assert got == [0, 1, 2, -1]


def test_dedupe_first_by_class_list(spark):
    df = spark.createDataFrame([("x", "cas2", 0, "AA"), ("y", "cas1", 5, "AA"), ("z", "cas10", 1, "BB")],
                               "record_id string, class string, record_pos long, seq string")
    got = sorted((r["class"], r.seq) for r in curate.dedupe_by_sequence(df, CAS).collect())
    assert got == [("cas1", "AA"), ("cas10", "BB")]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    got = {r.label: round(r.weight, 6) for r in balance.class_weights(df, "label").collect()}
    assert got == {0: 0.666667, 1: 2.0}
    t = spark.createDataFrame([([0, 0, 1],), ([0, 0, 0, 0, 0],)], "labels array<int>")
    got = {r.label: round(r.weight, 6) for r in balance.token_class_weights(t).collect()}
    assert got == {0: 0.571429, 1: 4.0}


def test_multiclass_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0])), "y int, p int")
    cm = M.confusion_table(df)
    assert round(M.accuracy(cm).first()[0], 6) == 0.6
    w = M.weighted_prf(cm).first()
    assert (round(w.precision, 6), round(w.recall, 6), round(w.f1, 6)) == (0.466667, 0.6, 0.52)
    assert round(M.balanced_accuracy(cm).first()[0], 6) == 0.5
    assert M.confusion_matrix(cm).count() == 4  # the cells that occur
    assert M.confusion_matrix(cm, [0, 1, 2]).count() == 9
    rep = {r.label: r for r in M.classification_report(cm).collect()}
    assert rep["accuracy"].support == 5 and round(rep["weighted avg"].f1, 6) == 0.52


def test_binary_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1], [0, 0, 1, 0, 1, 0])), "y int, p int")
    b = M.binary_metrics(M.confusion_table(df)).first()
    assert (b.tn, b.fp, b.fn, b.tp) == (3, 1, 1, 1)
    assert (b.precision, b.recall, b.f1) == (0.5, 0.5, 0.5)
    assert round(b.roc_auc, 6) == 0.625 and round(b.mcc, 6) == 0.25


def test_perplexity_and_dual_loss(spark):
    df = spark.createDataFrame([([5, -100, 7], [0.5, 0.9, 0.25])], "labels array<int>, p_true array<double>")
    p = M.perplexity(df).first()
    assert round(p.mean_ce, 6) == 1.039721 and round(p.perplexity, 6) == 2.828427
    one = spark.range(1).select(M.dual_task_loss(F.lit(1.039721), F.lit(0.02)).alias("l")).first()
    assert round(one.l, 6) == 2.0


def test_row_r2_argument_order(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 2.0, 3.0])], "p array<double>, t array<double>")
    r = df.select(M.row_r2(F.col("p"), F.col("t"), "target").alias("a"),
                  M.row_r2(F.col("p"), F.col("t"), "pred").alias("b")).first()
    assert round(r.a, 6) == 0.5 and round(r.b, 6) == 0.785714


def test_regression_metrics(spark):
    df = spark.createDataFrame([([1.0, 10.0], [1.0, 11.0]), ([3.0, 10.0], [3.0, 10.0]),
                                ([2.0, 13.0], [3.0, 13.0])], "y array<double>, p array<double>")
    r = M.regression_metrics(df).first()
    assert (round(r.mse, 6), round(r.rmse, 6), round(r.r2, 6)) == (0.333333, 0.57735, 0.666667)


def test_family_prefix_rule(spark):
    # hash order C(1) A(8) D(1), 20 %: C and A (the crossing family) go to test
    fam = spark.createDataFrame([("C", "0", 1), ("A", "1", 8), ("D", "2", 1)], "f string, h string, n long")
    sel = prefix_select(fam, F.col("h"), F.col("f"), 10 * 0.2, weight=F.col("n"))
    assert {r.f for r in sel.where("selected").collect()} == {"C", "A"}
    # C(2) A(5) B(3): exactly 20 % after C, so only C
    fam = spark.createDataFrame([("C", "0", 2), ("A", "1", 5), ("B", "2", 3)], "f string, h string, n long")
    sel = prefix_select(fam, F.col("h"), F.col("f"), 10 * 0.2, weight=F.col("n"))
    assert {r.f for r in sel.where("selected").collect()} == {"C"}


def test_family_split_null_rows_stay_in_train(spark):
    rows = [("A", i) for i in range(2)] + [(None, i + 2) for i in range(8)]
    df = spark.createDataFrame(rows, "family string, record_pos long")
    got = split.family_split(df, 0.2, 42).collect()
    assert {r.family for r in got if r.split == "test"} == {"A"}
    assert all(r.split == "train" for r in got if r.family is None)


def test_stratified_quotas(spark):
    rows = [("a",)] * 13 + [("b",)] * 4 + [("c",)] * 3
    df = spark.createDataFrame(rows, "class string")
    q = {r._sk: r.limit for r in split.stratified_quotas(df, "class", 0.1).collect()}
    assert q == {"a": 1, "b": 1, "c": 0}


def test_paged_tsv(spark):
    path = scratch_path(spark, "pages-golden")
    hdr = "\t".join(tables.ANNOTATION_FIELDS)
    import os
    for page, ids in ((1, ["P1", "P2"]), (2, ["P3", "P4"]), (3, ["P5", "P6"])):
        d = os.path.join(path.removeprefix("file:"), f"page={page}")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "part.tsv"), "w") as f:
            f.write(hdr + "\n" + "\n".join(i + "\tfam\tMKT" for i in ids) + "\n")
    got = tables.read_paged_tsv(spark, path, top_n=3).collect()
    assert sorted(r.accession for r in got) == ["P1", "P2", "P3", "P4"]
    assert got[0].ft_mod_res is None  # short rows: missing trailing fields are null


def test_header_length_filter(spark):
    df = spark.createDataFrame([("x CR=1", "AAAAA"), ("y CR=10", "AAAAA"), ("z CR=0", "A" * 9),
                                ("w CR=1", "AAA")], "description string, seq string")
    got = [r.description for r in annotate.header_length_filter(df, "CR=1", 4).collect()]
    assert got == ["x CR=1", "y CR=10"]
    exact = annotate.header_length_filter(df, "CR=1", 4, exact_token=True).collect()
    assert [r.description for r in exact] == ["x CR=1"]


def test_edit_distance_and_argmax(spark):
    r = spark.range(1).select(evolve.edit_distance(F.lit("MKTAY"), F.lit("MKSAYI")).alias("d"),
                              evolve.edit_distance(F.lit("MKTAY"), F.lit("MKSAYI"), F.lit(3)).alias("b"),
                              M.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7))).alias("a")).first()
    assert (r.d, r.b, r.a) == (2, 2, 1)


def test_write_fasta_lines(spark):
    path = scratch_path(spark, "fasta-golden")
    df = spark.createDataFrame([("r1 d", "A" * 61, "c1")], "description string, seq string, class string")
    writers.write_fasta(df, path, ["class"])
    lines = [r.value for r in spark.read.option("recursiveFileLookup", "true").text(path).collect()]
    assert lines == [">r1 d", "A" * 60, "A"]
    back = fasta.read_fasta(spark, path, recursive=True).first()
    assert back.seq == "A" * 61 and back.description == "r1 d"


def test_mean_pool_variants(spark):
    # begin=9, residues 1 and 3, end=5, one pad=100
    df = spark.createDataFrame([([[9.0], [1.0], [3.0], [5.0], [100.0]], [1, 1, 1, 1, 0], 2)],
                               "v array<array<double>>, mask array<int>, n int")
    r = df.select(embed.mean_pool_residues(F.col("v"), F.col("n"), 1).alias("a"),
                  embed.mean_pool_masked(F.col("v"), F.col("mask"), 1).alias("b")).first()
    assert r.a == [2.0] and r.b == [4.5]


def test_split_by_ids(spark):
    recs = spark.createDataFrame([("r1", "c"), ("r2", "c"), ("r3", "c")], "record_id string, class string")
    tr = spark.createDataFrame([("r1", "c")], "record_id string, class string")
    va = spark.createDataFrame([("r2", "c")], "record_id string, class string")
    got = sorted((r.record_id, r.split) for r in curate.split_by_ids(recs, tr, va).collect())
    assert got == [("r1", "train"), ("r2", "validation")]


def test_ordered_cumsum_matches_window(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.choice(["g1", "g2", None]), rnd.randrange(1 << 20), rnd.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, w long").dropDuplicates(["g", "k"])
    got = ordered_cumsum(df, "g", ["k"], F.shiftright(F.col("k"), 10), F.col("w"), "c")
    exp = {}
    for g in {r[0] for r in rows}:
        acc = 0
        for k, w in sorted({(r.k, r.w) for r in df.collect() if r.g == g}):
            acc += w
            exp[(g, k)] = acc
    assert {(r.g, r.k): r.c for r in got.collect()} == exp


def test_resolve_input_and_class_from_path(spark):
    assert fasta.resolve_input("/data/tree/") == "tree"
    assert fasta.resolve_input("/data/x.fa.gz") == "file"
    with pytest.raises(ValueError):
        fasta.resolve_input("/data/x.txt")
    df = spark.createDataFrame([("file:/d/cas1/a.fasta",), ("/d/class=cas13/part-0.fasta.gz",)], "p string")
    got = [r[0] for r in df.select(annotate.class_from_path(F.col("p"))).collect()]
    assert got == ["cas1", "cas13"]
