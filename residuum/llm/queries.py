"""Queries ``opN_<name>`` over the whole test tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import (decontaminate, html_extract, language_id, ngram_jaccard, substring_dedup, token_counts, topk_search,
                          toxicity, url_filter)
from residuum.llm import sentencepiece
from residuum.llm.common import held_out, table, trainable
from residuum.llm.registry import query

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def language_sample(docs: DataFrame) -> dict[str, str]:
    return language_id.learn(docs.filter(trainable(F.col("doc_id"))), key=F.col("doc_id"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_sample(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


@query("op4_url_filters", f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM parts JOIN rules
    ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
""")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=("page_id",))


@query("op5_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q
  JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_substring_dedup", """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE doc_id IS NOT NULL),
m AS (SELECT k, min(doc_id) AS m FROM s GROUP BY k),
gone AS (
  SELECT DISTINCT rid, i + j AS p FROM (SELECT rid, i FROM s JOIN m USING (k) WHERE m < doc_id), range(50) AS t(j)),
kept AS (
  SELECT d.rid, count(g.p) AS n_removed,
         coalesce(string_agg(w[q], ' ' ORDER BY q) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM d, unnest(range(1, len(w) + 1)) AS t(q) LEFT JOIN gone g ON g.rid = d.rid AND g.p = q GROUP BY d.rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TOXIC_SCORE = 0.7


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, doc_id = table(spark, sf_dir, "documents"), F.col("doc_id")
    model = toxicity.learn(
        docs.filter(trainable(doc_id)).select(doc_id.alias("id"), "text"),
        table(spark, sf_dir, "labels").filter(trainable(doc_id)).select(doc_id.alias("id"), F.col("toxic").alias("label")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(doc_id).alias("held_out"), "score",
                        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


PIECES = "piece_bpe_32k.model"


def encoded(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, the ids of the text, their number, and whether they decode to the text."""
    vocab = sentencepiece.Vocabulary.read(tokenizer_path(PIECES))
    marked = F.coalesce(F.col("text").contains(sentencepiece.MARK), F.lit(False))  # a mark decodes to a space
    out = sentencepiece.encode(docs.withColumn("_marked", marked), vocab, keep=(*keep, "_marked"), round_trip=True)
    return out.select(*keep, "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"),
                      (F.col("round_trip") & ~F.col("_marked")).alias("round_trip"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ("doc_id",))
