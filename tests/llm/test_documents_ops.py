"""op1, op2, op9: operators that answer for each document by itself."""

import math
import random
import zlib

import pytest
from llm_helpers import SF, documents, query, table_dir, words
from pyspark.sql import functions as F

from residuum.llm import language_id, token_counts, toxicity
from residuum.llm.queries import tokenizer_path


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


ODD_TEXTS = [None, "", " ", "  a  b ", "it's a test, isn't it?", "a\n\n b\t c", "x <|endoftext|> y<|endoftext|>z",
             "日本語 テキスト", "😀 ok", "a" * 3000, "1234 " * 500, "ab1" * 30000, "end ", "\u2003wide\u2003 x", "a\x1c b"]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    texts = ODD_TEXTS + [words(rng, 400) for _ in range(5)] + ["same text"] * 2
    got = token_counts.token_counts(documents(spark, texts), tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(got) == len(texts)
    tok = library()
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.n_tokens == len(tok.encode(t, add_special_tokens=False).ids), repr(t[:40])
        assert r.n_bytes == len(t.encode())


def test_token_counts_query(spark, tmp_path):
    docs = documents(spark, ["a b", None, "x " * 600])
    d = table_dir(tmp_path, documents=docs.withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(1)))
    got = {r.doc_id: r for r in query("op1")(spark, d).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (0, 0, False)
    assert got[2].over_limit and not got[0].over_limit


@pytest.mark.parametrize("op", ["op1", "op2", "op6", "op7", "op8", "op10", "op3", "op9", "op4", "op5", "pipeline"])
def test_empty_tables(spark, tmp_path, op):
    docs = documents(spark, [(1, "x")]).limit(0)
    d = table_dir(tmp_path, documents=docs, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                  pages=spark.createDataFrame([], "page_id long, url string, html string"),
                  embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert query(op)(spark, d).count() == 0


def test_null_ids_do_not_crash(spark, tmp_path):
    docs = documents(spark, [(None, "some words here"), (None, None), (1, "some words here"), (1, "some words here")])
    d = table_dir(tmp_path, documents=docs, labels=spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int"),
                  benchmark=spark.createDataFrame([(None, None)], "item_id long, text string"))
    for op, n in (("op1", 4), ("op2", 4), ("op9", 4), ("op6", 4), ("op10", 4), ("op8", 0), ("op3", 4)):
        assert len(query(op)(spark, d).collect()) == n, op


def test_pipeline_with_null_ids(spark, tmp_path):
    """Rows without an id are judged by language and benchmark; those that compare documents
    leave them alone (``one_of_each``, ``remove_repeats``), a copy of another row included."""
    rng = random.Random(31)
    texts = [words(rng, 40) for _ in range(7)]
    rows = [(None, texts[0]), (1, texts[0]), (None, None), (None, texts[6]), (None, ""), *[(i + 1, texts[i]) for i in range(1, 6)]]
    d = table_dir(tmp_path, documents=documents(spark, rows),
                  benchmark=spark.createDataFrame([(None, None), (None, "")], "item_id long, text string"))
    got = [r.doc_id for r in query("pipeline")(spark, d).collect()]
    assert sorted(got, key=str) == [1, 2, 3, 4, 5, 6, None, None]


# ------------------------------------------------------------------ language


def brute_phrases(text: str, sample: str) -> int:
    """Longest-match phrases of windows of the reduced text, counted one by one; a
    character that the sample lacks is a phrase."""
    reduced = language_id.letters(text)
    total = 0
    for lo in range(0, len(reduced), language_id.WINDOW):
        w, at = reduced[lo:lo + language_id.WINDOW], 0
        while at < len(w):
            end = at + 1
            while end <= len(w) and w[at:end] in sample:
                end += 1
            at = max(at + 1, end - 1)
            total += 1
    return total


def brute_language(text, samples):
    """The language of least cost, first by name on ties, and the margin to the next."""
    size = len(language_id.letters(text))
    if not size or not samples:
        return "und", 0.0
    cost = sorted((brute_phrases(text, v) * math.log2(max(2, len(v))) / size, k) for k, v in samples.items())
    return cost[0][1], (cost[1][0] / (cost[0][0] + cost[1][0]) if len(cost) > 1 else 1.0)


def check_languages(samples, texts):
    import pyarrow as pa
    langs, scores = language_id.Model(samples).judge(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        expected = brute_language(text, samples)
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-12), text


def test_predictions_equal_a_parse_of_the_samples():
    rng = random.Random(3)
    alphabets = {"aa": "abcd", "bb": "cdef", "cc": "abxyz", "dd": "é日本語"}
    samples = {k: words(rng, 60, v) for k, v in alphabets.items()}
    texts = [words(rng, rng.randint(1, 120), rng.choice([*alphabets.values(), "abcdef", "qrs", "aé日"])) for _ in range(120)]
    check_languages(samples, texts + [None, "", "123 *** !!", "a", "Q", samples["aa"], samples["bb"] * 3, "日本" * 300, "a  b\n\tc"])
    check_languages({"aa": samples["aa"]}, texts[:9])


def test_predictions_of_the_test_table_equal_a_parse(spark):
    from residuum.llm.queries import language_sample
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language_sample(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in query("op2")(spark, SF).collect()}
    for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))[:60]:
        lang, score = brute_language(r.text, samples)
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=1e-12))


def test_wide_alphabets_stay_small():
    """Eight languages of thousands of ideographs each."""
    rng = random.Random(4)
    alphabets = {f"l{k}": [chr(0x4E00 + k * 1500 + i) for i in range(6000)] for k in range(8)}
    samples = {k: "".join(rng.choices(v, k=24_000)) for k, v in alphabets.items()}
    model = language_id.Model(samples)
    assert sum(a.nbytes for a in (model.base, model.entry, model.code_of, model.start, model.again)) < 40 << 20
    texts = ["".join(rng.choices(v, k=40)) for v in alphabets.values()] + [samples[k][100:400] for k in samples]
    import pyarrow as pa
    langs, _ = model.judge(pa.array(texts))
    assert langs[8:] == sorted(samples)
    check_languages(samples, texts[6:10])


def test_no_language_is_left_out(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30, chr(0x4E00 + k) + chr(0x5E00 + k) + "ab"), f"l{k:03}") for i, k in enumerate([0] * 400 + list(range(300)) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.learn(docs)) == {f"l{k:03}" for k in range(300)}
    many = spark.range(language_id.MAX_LANGS + 1).selectExpr("'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        language_id.learn(many)


def test_language_query_on_held_out(spark):
    got = query("op2")(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_without_labels(spark):
    docs = documents(spark, ["hello world", "  ", None]).withColumn("lang", F.lit(None).cast("string"))
    samples = language_id.learn(docs)
    assert samples == {}
    assert {r.lang_pred for r in language_id.identify(docs, samples).collect()} == {"und"}
    assert [r.text for r in language_id.recognised(docs, samples).collect()] == ["hello world"]


# ------------------------------------------------------------------ toxicity


def test_toxicity_windows_hold_the_whole_text():
    for text in ("", "one", words(random.Random(4), 300), "x" * 5000, ("y" * 700 + " ") * 5):
        normal = toxicity.normal(text)
        assert b"".join(w[1:-1] for w in toxicity.windows(normal)) == normal


def test_toxicity_learns_inserted_words(spark):
    rng = random.Random(5)
    insults = ["scoundrel", "nitwit", "dreadful"]
    rows = []
    for i in range(600):
        ws = words(rng, 80, "abcdefghijklmnop", 7).split()
        if i % 3 == 0:
            for _ in range(6):
                ws.insert(rng.randrange(len(ws)), rng.choice(insults))
        rows.append((i, " ".join(ws), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    half = df.filter("doc_id < 400")
    model = toxicity.learn(half.select(F.col("doc_id").alias("id"), "text"),
                           half.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    got = toxicity.score(df.filter("doc_id >= 400"), model).join(df, "doc_id").collect()
    hits = sum((r.score >= 0.7) == (r.toxic == 1) for r in got)
    assert hits >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(documents(spark, ODD_TEXTS), model).collect())


def test_toxicity_scores_equal_a_plain_computation(spark):
    """Both dictionaries are the trainer's; a text's score is what its windows' lengths under them say."""
    import numpy as np
    import zstandard
    from residuum.llm.common import table, trainable
    i = F.col("doc_id")
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.learn(docs.filter(trainable(i)).select(i.alias("id"), "text"),
                           labels.filter(trainable(i)).select(i.alias("id"), F.col("toxic").alias("label")))
    ordinary, toxic = model.dictionaries
    assert toxic.startswith(ordinary) and len(toxic) > len(ordinary)
    lengths = []
    for d in (ordinary, toxic):
        how = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=toxicity.WINDOW, dict_size=len(d), min_match=5, strategy=zstandard.STRATEGY_LAZY2,
            write_checksum=False, write_content_size=False, write_dict_id=False)
        z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        lengths.append(lambda w, z=z, how=how: len(zstandard.ZstdCompressor(dict_data=z, compression_params=how).compress(w)))
    rows = sorted(docs.collect(), key=lambda r: len(r.text or ""))[::40]
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter(i.isin([r.doc_id for r in rows])), model).collect()}
    for r in rows:
        weights = []
        for w in toxicity.windows(toxicity.normal(r.text)):
            gain = min(max(lengths[0](w) - lengths[1](w), toxicity.GAINS[0]), toxicity.GAINS[1])
            weights.append(model.weight[gain - toxicity.GAINS[0]])
        total, mean = (min(max(sum(weights), -30), 30), sum(weights) / len(weights)) if weights else (0, 0)
        z = model.curve[0] + model.curve[1] * total + model.curve[2] * mean
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_without_one_class(spark):
    docs = documents(spark, ["a b", None, ""])
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, None)], "id long, label int")
    model = toxicity.learn(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0, 0.0]
