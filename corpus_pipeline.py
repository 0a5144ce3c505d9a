"""Corpus pipeline: from raw ``documents`` to token ids.

Each stage gets what its predecessor kept (the first gets ``documents``) and returns
a DataFrame, which is written as Parquet and read again for the next. All stages but
the last return the columns of ``documents``.

1. language ID: texts in no known language (no letters, or null) go;
2. n-gram Jaccard join: one document of each group of near duplicates stays;
3. substring dedup: passages of 50 words or more that an earlier document holds are
   cut out of the text; a document of which nothing is left goes;
4. benchmark decontamination: documents that overlap with a benchmark item go;
5. SentencePiece: the ids of the text, their number, and whether they decode to it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import decontaminate, language_id, ngram_jaccard, queries, substring_dedup
from residuum.llm.common import table
from residuum.llm.registry import query
from residuum.session import ensure_checkpoint_dir, scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepared(stage: Stage) -> Stage:
    """Run a stage with the package shipped and the shared folder set; extra columns
    of ``docs`` go through it under names that clash with none of the stage's own."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        own = {f"extra_column_{i}": c for i, c in enumerate(docs.columns) if c not in COLUMNS}
        alias = {c: a for a, c in own.items()}
        out = stage(spark, docs.toDF(*[alias.get(c, c) for c in docs.columns]), sf_dir)
        return out.toDF(*[own.get(c, c) for c in out.columns])
    return run_stage


@prepared
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.recognised(docs, queries.language_sample(docs))


@prepared
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.one_of_each(docs)


@prepared
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(docs, keep=tuple(docs.columns))
    changed = F.col("n_removed") > 0
    return found.filter(~changed | (F.col("n_removed") < F.col("n_words"))) \
        .withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))) \
        .withColumn("n_chars", F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))) \
        .select(*docs.columns)


@prepared
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@prepared
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.encoded(docs, tuple(c for c in docs.columns if c != "text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_jaccard", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmarks),
    ("sentencepiece", token_ids),
]

# Language ID, MinHash and the piece lattice have no SQL form.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written under the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
