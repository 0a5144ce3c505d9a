"""Encoder, pooling, vector-layout and model-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from residuum.operators import embed, tokens
from residuum.plans.q_annotate import LETTERS
from residuum.plans.registry import query
from residuum.sources.testbed import REC_SQL, SECOND_SQL, read_table, records, second_model_embedding

DIM = 8


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def token_vector_table():
    """Stand-in per-token residue vectors (a model's last layer would
    supply these): ``v(t)[d] = (((7t + 3d) mod 11) - 5) / 8``, 33 x 8."""
    return [[(((t * 7 + d * 3) % 11) - 5) / 8.0 for d in range(DIM)] for t in range(33)]


def _vectors(ids):
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in token_vector_table()])
    return F.transform(ids, lambda t: F.element_at(table, t + 1))


KMER_SQL = REC_SQL + """,
km AS (SELECT record_id, CAST(('0x' || substring(md5(substring(seq, p, 3)), 1, 8)) AS BIGINT) % 64 AS bucket
       FROM rec, unnest(range(1, length(seq) - 1)) AS t(p)),
cnt AS (SELECT record_id, bucket, count(*) AS n FROM km GROUP BY 1, 2),
nrm AS (SELECT record_id, sqrt(sum(n * n)) AS norm FROM cnt GROUP BY 1)
SELECT record_id, CAST(bucket AS INTEGER) AS bucket, round(n / norm, 6) AS value
FROM cnt JOIN nrm USING (record_id)"""


def _explode_vec(df, id_col, vec_col):
    return df.select(id_col, F.posexplode(vec_col).alias("bucket", "value")).where(
        F.col("value") != 0).select(id_col, F.col("bucket").cast("int"), r6(F.col("value")).alias("value"))


@query("embed_sequences", "WITH " + KMER_SQL)
def q_embed_sequences(spark, sf):
    e = embed.embed_sequences(records(spark, sf).select("record_id", "seq"))
    return _explode_vec(e, "record_id", "embedding")


@query("embed_sequences_sql", "WITH " + KMER_SQL)
def q_embed_sequences_sql(spark, sf):
    e = embed.kmer_profile_sql(records(spark, sf), "record_id")
    return e.select("record_id", "bucket", r6(F.col("value")).alias("value"))


@query("embed_annotation_text", """WITH w AS (
  SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS w FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 384 AS bucket FROM w WHERE w <> ''),
cnt AS (SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY 1, 2),
nrm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM cnt GROUP BY 1)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(n / norm, 6) AS value FROM cnt JOIN nrm USING (doc_id)""")
def q_embed_annotation_text(spark, sf):
    d = read_table(spark, sf, "documents")
    e = embed.vector_entries(embed.embed_annotation_text(d.select("doc_id", "text")), "doc_id")
    return e.select("doc_id", "bucket", r6(F.col("value")).alias("value"))


POOL_SQL = REC_SQL + f""",
tok AS (SELECT record_id, list_transform(string_split(seq, ''), lambda c: 3 + instr('{LETTERS}', c)) AS ids
        FROM rec WHERE length(seq) > 0),
dims AS (SELECT record_id, ids, d FROM tok, unnest(range(0, {DIM})) AS t(d))"""


def _pool_input(spark, sf):
    t = records(spark, sf).where(F.length("seq") > 0).select(
        "record_id", F.length("seq").alias("n"),
        tokens.tokenize_residues(F.col("seq"), None, add_special=True).alias("input_ids"))
    return t.withColumn("vectors", _vectors(F.col("input_ids"))).withColumn(
        "mask", tokens.attention_mask(F.col("input_ids")))


def _explode_pool(df):
    return df.select("variant", "record_id", F.posexplode("pooled").alias("dim", "value")).select(
        "variant", "record_id", F.col("dim").cast("bigint"), r6(F.col("value")).alias("value"))


VEC_SQL = "((t * 7 + d * 3) % 11 - 5) / 8.0"


@query("mean_pool", f"""WITH {POOL_SQL}
SELECT 'residues' AS variant, record_id, d AS dim,
       round(list_sum(list_transform(ids, lambda t: {VEC_SQL})) / len(ids), 6) AS value FROM dims
UNION ALL
SELECT 'masked', record_id, d,
       round(({VEC_SQL.replace('t ', '0 ')} + {VEC_SQL.replace('t ', '2 ')}
              + list_sum(list_transform(ids, lambda t: {VEC_SQL}))) / (len(ids) + 2), 6) FROM dims""")
def q_mean_pool(spark, sf):
    p = _pool_input(spark, sf)
    both = p.select("record_id", embed.mean_pool_residues(F.col("vectors"), F.col("n"), DIM).alias("residues"),
                    embed.mean_pool_masked(F.col("vectors"), F.col("mask"), DIM).alias("masked"))  # one pass for both
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("pooled")) for v in ("residues", "masked")])
    return _explode_pool(both.select("record_id", F.inline(variants)))


@query("position_weighted_pool", f"""WITH {POOL_SQL},
full_ids AS (SELECT record_id, d, list_concat([0], ids, [2]) AS f FROM dims)
SELECT record_id, d AS dim,
       round(list_sum(list_transform(f, lambda t, i: i * {VEC_SQL})) / (len(f) * (len(f) + 1) / 2), 6) AS value
FROM full_ids""")
def q_position_weighted_pool(spark, sf):
    p = _pool_input(spark, sf).withColumn(
        "pooled", embed.position_weighted_pool(F.col("vectors"), F.col("mask"), DIM))
    return p.select("record_id", F.posexplode("pooled").alias("dim", "value")).select(
        "record_id", F.col("dim").cast("bigint"), r6(F.col("value")).alias("value"))


@query("wide_to_array", """SELECT vec_id, len(embedding) AS n_dim, 1 AS same,
       round(CAST(embedding[1] AS DOUBLE), 6) AS e_first, round(CAST(embedding[64] AS DOUBLE), 6) AS e_last
FROM embeddings""")
def q_wide_to_array(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    wide = embed.array_to_wide(e, "embedding", 64)
    back = embed.wide_to_array(wide.withColumnRenamed("embedding", "orig") if "embedding" in wide.columns
                               else wide, 64, out="back")
    j = back.join(e, "vec_id")
    return j.select("vec_id", F.size("back").cast("long").alias("n_dim"),
                    (F.col("back") == F.col("embedding")).cast("int").alias("same"),
                    r6(F.col("back")[0].cast("double")).alias("e_first"),
                    r6(F.col("back")[63].cast("double")).alias("e_last"))


@query("compare_models", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
                             {SECOND_SQL} AS b FROM embeddings),
d AS (SELECT vec_id, a, b, list_transform(b, lambda x, i: x - a[i]) AS diff FROM v)
SELECT vec_id, round(sqrt(list_sum(list_transform(diff, lambda x: x * x))), 6) AS l2_drift,
       round(list_sum(list_transform(a, lambda x, i: x * b[i]))
             / (sqrt(list_sum(list_transform(a, lambda x: x * x))) * sqrt(list_sum(list_transform(b, lambda x: x * x)))), 6)
       AS cosine FROM d""")
def q_compare_models(spark, sf):
    e = read_table(spark, sf, "embeddings")
    m1 = e.select("vec_id", "embedding")
    m2 = e.select("vec_id", second_model_embedding().alias("embedding"))
    c = embed.compare_models(m1, m2, "vec_id")
    return c.select("vec_id", r6(F.col("l2_drift")).alias("l2_drift"), r6(F.col("cosine")).alias("cosine"))
