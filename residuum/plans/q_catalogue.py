"""Catalogue search and batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from residuum.operators.batching import length_bucketed_batches
from residuum.operators.curate import union_all_ids
from residuum.plans.registry import query
from residuum.session import scratch_path
from residuum.sources.catalogue import SUFFIXES, search_title_index, title_term_search, write_title_index
from residuum.sources.testbed import REC_SQL, read_table, records

TERMS = ["an", "the", "de", "la", "ou"]
TOPN = 25


def _catalogue(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("title"))


SEARCH_SQL = f"""tok AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS record_id, w FROM (
         SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS w FROM documents)),
terms AS (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in TERMS)}) AS t(term)),
suf AS (SELECT * FROM (VALUES {', '.join(f"('{s}')" for s in SUFFIXES)}) AS s(suffix)),
v AS (SELECT term, concat(term, suffix) AS variant FROM terms, suf),
m AS (SELECT term, variant, record_id FROM tok JOIN v ON tok.w = v.variant),
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY md5(concat('42', ':', record_id)), record_id) AS rn
      FROM m),
found AS (SELECT term, variant, record_id FROM r WHERE rn <= {TOPN})"""


@query("title_term_search", f"WITH {SEARCH_SQL} SELECT * FROM found")
def q_title_term_search(spark, sf):
    return title_term_search(_catalogue(spark, sf), TERMS, TOPN, 42).select(
        "term", "variant", "record_id")


@query("title_index_search", f"WITH {SEARCH_SQL} SELECT * FROM found")
def q_title_index_search(spark, sf):
    path = scratch_path(spark, "title-index")
    write_title_index(_catalogue(spark, sf), path)
    return search_title_index(spark, path, TERMS, TOPN, 42).select("term", "variant", "record_id")


@query("union_all_ids", f"""WITH {SEARCH_SQL}
SELECT record_id, count(*) AS n_occurrences FROM found GROUP BY record_id""")
def q_union_all_ids(spark, sf):
    # one frame per term's search, concatenated; duplicates stay
    ids = union_all_ids([title_term_search(_catalogue(spark, sf), [t], TOPN, 42).select("record_id") for t in TERMS])
    return ids.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_occurrences"))


@query("length_bucketed_batches", f"""WITH RECURSIVE {REC_SQL},
sorted AS (SELECT record_id, length(seq) AS length,
                  row_number() OVER (ORDER BY length(seq) DESC, md5(concat('batches', ':', record_id))) - 1 AS pos FROM rec),
cuts AS (SELECT 0 AS pos, 0 AS batch_id
         UNION ALL SELECT c.pos + greatest(1, 4096 // (s.length + 1)), c.batch_id + 1 FROM cuts c JOIN sorted s ON s.pos = c.pos)
SELECT s.record_id, CAST(s.length AS BIGINT) AS length, CAST(max(c.batch_id) AS BIGINT) AS batch_id
FROM sorted s JOIN cuts c ON c.pos <= s.pos GROUP BY s.record_id, s.length""")
def q_length_bucketed_batches(spark, sf):
    r = records(spark, sf).select("record_id", "seq")
    return length_bucketed_batches(r, "record_id", "seq", 4096, 1).withColumn("length", F.col("length").cast("long"))
