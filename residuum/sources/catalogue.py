"""SRC9: term search over a local catalogue of titles (re-aimed from a web
search): every class term with every suffix, matched on title tokens,
at most ``topn`` ids per variant, concatenated without dedupe.  A catalogue that
is searched often gets a table of postings, of which a search reads the
partitions of its variants only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators.curate import term_variants
from residuum.operators.split import topn_per_group

# The suffixes added to each base term.
SUFFIXES = ["", "a", "b", "c", "d"]


def title_term_search(catalogue: DataFrame, terms: Sequence[str], topn: int, seed=42,
                      id_col: str = "record_id", title_col: str = "title",
                      suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Rows ``(term, variant, record_id)``; an id found by two variants
    appears twice (SET2 keeps duplicates).

    Title tokens are exploded in the scan task and joined to the literal
    variant table (broadcast: its size is terms x suffixes); only matching
    tokens are deduplicated, so the shuffle carries matches, not all tokens.
    """
    v = term_variants(terms, suffixes).select("term", "variant")
    tok = catalogue.select(id_col, F.explode(F.split(F.lower(F.col(title_col)), r"\W+")).alias("tok"))
    hits = tok.join(F.broadcast(v), tok["tok"] == v["variant"]).select("term", "variant", id_col)
    hits = hits.dropDuplicates(["variant", id_col])
    return topn_per_group(hits, "variant", topn, seed, id_col)


INDEX_BUCKETS = 256
INDEX_SALTS = 8


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(INDEX_BUCKETS)).cast("int")


def write_title_index(catalogue: DataFrame, path: str, id_col: str = "record_id", title_col: str = "title") -> None:
    """Postings ``(tok, id)`` of all title tokens, distinct, as Parquet partitioned by a
    hash of the token and sorted by token in each file.  A row's tokens are made distinct
    before the shuffle (ids may repeat: the search drops repeats); a partition is written
    by ``INDEX_SALTS`` tasks, so a very common token is not one task's."""
    tok = catalogue.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.col(title_col)), r"\W+"))).alias("tok"))
    salt = F.pmod(F.xxhash64("id"), F.lit(INDEX_SALTS))
    tasks = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (tok.withColumn("bucket", _bucket("tok")).repartition(tasks, "bucket", salt).sortWithinPartitions("bucket", "tok")
        .write.mode("overwrite").partitionBy("bucket").parquet(path))


def search_title_index(spark: SparkSession, path: str, terms: Sequence[str], topn: int, seed=42,
                       id_col: str = "record_id", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """What ``title_term_search`` finds, from the postings at ``path``.  The literal
    variants name their partitions, and inside these their tokens are pushed down."""
    v = term_variants(terms, suffixes).select("term", "variant")
    wanted = v.select("variant", _bucket("variant").alias("bucket")).distinct().collect()  # terms x suffixes rows
    postings = spark.read.parquet(path)
    hits = postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in wanted})) & F.col("tok").isin(sorted({r["variant"] for r in wanted})))
    hits = hits.join(F.broadcast(v), hits["tok"] == v["variant"]).select("term", "variant", F.col("id").alias(id_col))
    return topn_per_group(hits.dropDuplicates(["variant", id_col]), "variant", topn, seed, id_col)
