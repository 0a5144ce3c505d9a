"""Adapters from the shared test tables to protein-shaped frames.

The test tables are generic (documents, embeddings, labels, ...).  These
functions give them the shape the operators expect; ``REC_SQL`` etc. are the
same mappings in SQL for the DuckDB oracles.  Every query in the registry
reads whole tables through these adapters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.functions.residues import residue_only
from residuum.session import data_path, spread

# Class order used for "first occurrence" (the reference's class list order
# plays this role); deliberately not alphabetical.
CLASS_ORDER = ["en", "fr", "de", "es"]

RECORD_COLUMNS = ["record_id", "record_pos", "seq", "class", "family",
                  "description", "modified_residue", "source_file"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, name))


def records(spark: SparkSession, sf_dir: str, strip=residue_only) -> DataFrame:
    """``documents`` as sequence records (spread over the cores when the
    scan has fewer splits than cores; a no-op on large inputs).  ``strip``
    keeps the residues of a text: ``residue_only`` or ``residue_letters``."""
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("doc_id").alias("record_pos"),
        strip(F.col("text")).alias("seq"),
        F.col("lang").alias("class"),
        F.expr("nullif(source, 'src7')").alias("family"),
        F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang",
                    F.concat(F.lit("CR="), (F.col("doc_id") % 12).cast("string"))
                    ).alias("description"),
        F.concat(F.lit("MOD_RES "), (1 + F.col("doc_id") % 50).cast("string"),
                 F.lit("; MOD_RES "), (7 + F.col("doc_id") % 90).cast("string")
                 ).alias("modified_residue"),
        F.col("source").alias("source_file"),
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with truth, a stand-in prediction and logits.

    ``prediction`` is wrong on every 7th row; logit c of 10 is the sum of all
    embedding values whose index is c modulo 10.
    """
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "embedding", "label",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
         .otherwise(F.col("label")).alias("prediction"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
            F.filter("embedding", lambda x, i: i % 10 == c), F.lit(0.0),
            lambda a, x: a + x.cast("double"))).alias("logits"),
    )


def second_model_embedding(col: str = "embedding", id_col: str = "vec_id"):
    """A second model's vector for the same row (for model comparison)."""
    return F.transform(F.col(col), lambda x: x.cast("double") * 0.9 + (F.col(id_col) % 5) * 0.01)


def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels.quality`` as truth and a length-based score as P(class 1)."""
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id", "inner").select(
        "doc_id", F.col("quality").alias("y"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(2000.0)).alias("p1"))


# ---------------------------------------------------------------- SQL twins

REC_SQL = """rec AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id AS record_pos,
         upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq,
         lang AS class, nullif(source, 'src7') AS family,
         concat(doc_id, ' ', source, ' ', lang, ' CR=', doc_id % 12) AS description,
         concat('MOD_RES ', 1 + doc_id % 50, '; MOD_RES ', 7 + doc_id % 90) AS modified_residue,
         source AS source_file
  FROM documents)"""

EMB_SQL = """emb AS (
  SELECT vec_id, embedding, label,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS prediction,
         list_transform(range(0, 10), lambda c: coalesce(list_reduce(list_transform(
             list_filter(embedding, lambda x, i: (i - 1) % 10 = c), lambda x: CAST(x AS DOUBLE)),
             lambda a, x: a + x), 0.0)) AS logits
  FROM embeddings)"""

SECOND_SQL = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.9 + (vec_id % 5) * 0.01)"

BIN_SQL = """bin AS (
  SELECT l.doc_id, l.quality AS y, least(1.0, d.n_chars / 2000.0) AS p1
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

CLASS_RANK_SQL = "CASE class " + " ".join(
    f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASS_ORDER)) + f" ELSE {len(CLASS_ORDER)} END"
