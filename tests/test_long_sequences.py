"""Distances, pooling, k-mer profiles and first records on odd and long rows."""

import random

import pytest
from pyspark.sql import functions as F

from residuum.operators import embed, evolve
from residuum.plans import q_search


def test_proved_distances_are_the_plain_ones():
    rng = random.Random(7)
    a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    b = "".join("W" if i % 50 == 0 else ch for i, ch in enumerate(a))
    n = sum(x != y for x, y in zip(a, b))
    assert evolve._substitutions(a, b) == n > 300
    # a shift by one beats the places that differ: nothing is proved
    assert evolve._substitutions("ACDE" * 9, "CDEA" * 9) is None
    assert evolve._substitutions("", "") == 0 and evolve._substitutions("AA", "A") is None and evolve._substitutions(None, "A") is None


def test_edit_distance_with_bounds(spark):
    rng = random.Random(8)
    rows = [("ACDEF" * 4, "CDEFA" * 4, 20), ("ACD", "AWD", 0), ("ACD", "AWD", 1), ("", "", 0), (None, "A", 1), ("ACD", "ACD", None), ("😀é界", "😀e界", 3)]
    for n in (3, 10, 60, 200):
        a = "".join(rng.choice("AC") for _ in range(n))
        b = "".join(rng.choice("AC") if rng.random() < .1 else ch for ch in a)
        rows.append((a, b, sum(x != y for x, y in zip(a, b))))
    df = spark.createDataFrame(rows, "a string, b string, n int").repartition(2)
    got = df.select(evolve.edit_distance(F.col("a"), F.col("b"), F.col("n")).alias("d"),
                    F.call_function("levenshtein", "a", "b", "n").alias("e"),
                    evolve.edit_distance(F.col("a"), F.col("b")).alias("w"), F.levenshtein("a", "b").alias("p")).collect()
    assert [(r.d, r.w) for r in got] == [(r.e, r.p) for r in got]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_kmer_profile_of_odd_letters(spark, k):
    rows = [("1", "ACDEFACDE"), ("2", "aé界X-aé界X-"), ("3", "A" * 3), ("4", ""), ("5", None), ("6", "AC"), (None, "ACDE"), ("1", "ACDEF")]
    df = spark.createDataFrame(rows, "id string, seq string")
    got = {(r.id, r.bucket): round(r.value, 9) for r in embed.kmer_profile_sql(df, "id", k=k).collect()}
    counts = {}
    for i, s in rows:
        for p in range(len(s or "") - k + 1):
            key = (i, embed._py_bucket(s[p:p + k], 64))
            counts[key] = counts.get(key, 0) + 1
    norm = {i: sum(v * v for (j, _), v in counts.items() if j == i) ** .5 for i, _ in counts}
    assert got == {(i, b): round(v / norm[i], 9) for (i, b), v in counts.items()}


def test_weighted_pool_of_odd_rows(spark):
    rows = [([[1.0, 2.0], [3.0, 6.0]], [1, 3]), (None, [1]), ([[1.0, 2.0]], None), ([[1.0, None]], [1]), ([[1.0, 2.0], None], [1, 1]),
            ([[4.0, 5.0]] * 3000, [1] * 3000), ([], []), ([[1.0, 1.0]], [0]), ([[1.0, 1.0]], [1, 1])]
    df = spark.createDataFrame(rows, "v array<array<double>>, w array<int>").repartition(1)
    got = sorted((str(r.p) for r in df.select(embed.weighted_pool(F.col("v"), F.col("w"), 2).alias("p")).collect()))
    assert got == sorted(["[2.5, 5.0]", "[4.0, 5.0]", *["None"] * 7])


def test_first_record_of_each_class(spark, monkeypatch):
    rows = [("b", 2, "en", "AC"), ("a", 1, "en", "DE"), ("c", 3, None, "FG"), ("d", 4, None, "HI"), ("e", None, "fr", "KL")]
    df = spark.createDataFrame(rows, "record_id string, record_pos bigint, class string, seq string")
    monkeypatch.setattr(q_search, "records", lambda spark, sf: df)
    got = {r["class"]: (r.candidate_id, r.seq) for r in q_search.candidates(spark, "").collect()}
    assert got == {"en": ("a", "DE"), None: ("c", "FG"), "fr": (None, None)}


def test_distance_report_runs_the_generations(spark, monkeypatch):
    c = spark.createDataFrame([("a", "ACDEFG"), ("b", "KL")], "candidate_id string, seq string")
    best = spark.createDataFrame([("a", "ACDEFGHIKLMNP" * 2, 1.0), ("b", "KM", 1.0)], "candidate_id string, seq string, fitness double")
    pop = spark.createDataFrame([("a", 0, "ACDEFH", 1.0), ("b", 0, "KL", 1.0)], "candidate_id string, individual_id int, seq string, fitness double")
    monkeypatch.setattr(q_search, "_run", lambda spark, sf: (c, None, None, None, best))
    monkeypatch.setattr(q_search, "_mutated_population", lambda *a: pop)
    got = {r.candidate_id: (r.dist_original_best, r.within_length) for r in q_search.q_distance_report(spark, "").collect()}
    assert got == {"a": (1, False), "b": (0, True)}
