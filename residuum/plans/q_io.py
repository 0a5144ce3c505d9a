"""Source and sink queries: each writes files derived from the test tables
into the shared checkpoint folder and reads them back with our readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.operators import annotate, curate, metrics as M, split
from residuum.operators.chunk import chunk_sequence
from residuum.plans.q_annotate import SITES_SQL, with_sites
from residuum.plans.q_curate import FAMILY_CTES, STRAT_SQL
from residuum.plans.registry import query
from residuum.session import scratch_path
from residuum.sinks import writers
from residuum.sources import fasta, tables
from residuum.sources.testbed import EMB_SQL, REC_SQL, embedding_rows, read_table, records

SEED = 42


def _tree(spark, sf, compression=None, parts=("class",), name="fasta", df=None, plain=False):
    path = scratch_path(spark, name)
    writers.write_fasta(df if df is not None else records(spark, sf), path, list(parts),
                        compression=compression, plain_names=plain)
    return path


@query("read_fasta", f"""WITH {REC_SQL}
SELECT record_id, description, md5(seq) AS seq_md5, length(seq) AS seq_len FROM rec""")
def q_read_fasta(spark, sf):
    path = _tree(spark, sf)
    r = fasta.read_fasta(spark, path, recursive=True)
    return r.select("record_id", "description", F.md5("seq").alias("seq_md5"),
                    F.length("seq").cast("long").alias("seq_len"))


@query("write_fasta", f"""WITH {STRAT_SQL}
SELECT class, split, count(*) AS n_records,
       CAST(sum(1 + ceil(length(seq) / 60.0)) AS BIGINT) AS n_lines FROM strat GROUP BY 1, 2""")
def q_write_fasta(spark, sf):
    sp = split.stratified_split(records(spark, sf), "class", 0.1, SEED)
    path = _tree(spark, sf, parts=("class", "split"), df=sp)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("f"))
    pat = r"/class=([^/]+)/split=([^/]+)/[^/]+$"
    return (lines.select(F.regexp_extract("f", pat, 1).alias("class"),
                         F.regexp_extract("f", pat, 2).alias("split"),
                         F.col("value").startswith(">").cast("int").alias("hdr"))
            .groupBy("class", "split")
            .agg(F.sum("hdr").cast("long").alias("n_records"),
                 F.count(F.lit(1)).alias("n_lines")))


@query("scan_fasta_tree", f"""WITH {REC_SQL}
SELECT class, count(*) AS n_records, CAST(sum(length(seq)) AS BIGINT) AS n_residues
FROM rec GROUP BY class""")
def q_scan_fasta_tree(spark, sf):
    recs = records(spark, sf)
    root = scratch_path(spark, "tree")
    writers.write_fasta(recs, root + "/proteins", ["class"], compression="gzip", plain_names=True)
    # files that must be skipped: same records, names not matching the pattern
    recs.select(fasta.wrapped_fasta(F.col("description"), F.col("seq")).alias("v")) \
        .write.mode("overwrite").text(root + "/decoy")
    r = fasta.scan_fasta_tree(spark, root, fasta.FASTA_GZ_REGEX)
    return r.groupBy("class").agg(F.count(F.lit(1)).alias("n_records"),
                                  F.sum(F.length("seq")).cast("long").alias("n_residues"))


@query("scan_fasta_ranges", f"""WITH {REC_SQL}
SELECT record_id, md5(seq) AS seq_md5, length(seq) AS seq_len FROM rec""")
def q_scan_fasta_ranges(spark, sf):
    """Block-compressed files, cut between their members."""
    root = scratch_path(spark, "blocks")
    writers.write_block_fasta(records(spark, sf), root)
    r = fasta.scan_fasta_tree(spark, root, class_from_folder=False, range_bytes=256 << 10)
    return r.select("record_id", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("seq_len"))


@query("single_file_or_tree", f"""WITH {REC_SQL}
SELECT m.mode, class, count(*) AS n_records FROM rec, (VALUES ('tree'), ('file')) AS m(mode)
GROUP BY 1, 2""")
def q_single_file_or_tree(spark, sf):
    root = _tree(spark, sf, compression="gzip", name="single", plain=True)
    tree = fasta.read_fasta_input(spark, root + "/").withColumn("mode", F.lit("tree"))
    # every file by its own path, in one read
    one = fasta.read_fasta(spark, writers.list_files(spark, root), class_from_folder=True) \
        .withColumn("mode", F.lit("file"))
    both = tree.unionByName(one)
    return both.groupBy("mode", "class").agg(F.count(F.lit(1)).alias("n_records"))


TSV_SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_pos", T.LongType()),
    T.StructField("seq", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("family", T.StringType())])


def _tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    writers.write_tsv(records(spark, sf).select(*TSV_SCHEMA.fieldNames()), path)
    return path


@query("write_tsv", f"""WITH {REC_SQL}
SELECT record_id, record_pos, md5(seq) AS seq_md5, class, family FROM rec""")
def q_write_tsv(spark, sf):
    back = tables.read_tsv(spark, _tsv(spark, sf), TSV_SCHEMA)
    return back.select("record_id", "record_pos", F.md5("seq").alias("seq_md5"), "class", "family")


@query("read_tsv", f"""WITH {REC_SQL}
SELECT record_id, class FROM rec ORDER BY record_pos LIMIT 2000""")
def q_read_tsv(spark, sf):
    back = tables.read_tsv(spark, _tsv(spark, sf), TSV_SCHEMA, first_n=2000, order_col="record_pos")
    return back.select("record_id", "class")


@query("read_paged_tsv", f"""WITH {REC_SQL},
pg AS (SELECT record_pos // 100 AS page, count(*) AS n FROM rec GROUP BY 1),
keep AS (SELECT page FROM (SELECT page, sum(n) OVER (ORDER BY page) - n AS before FROM pg)
         WHERE before < 450)
SELECT record_id AS accession, record_pos // 100 AS page, family AS protein_families,
       md5(seq) AS seq_md5, modified_residue AS ft_mod_res
FROM rec WHERE record_pos // 100 IN (SELECT page FROM keep)""")
def q_read_paged_tsv(spark, sf):
    recs = records(spark, sf)
    cols = {c: F.lit(None).cast("string") for c in tables.ANNOTATION_FIELDS}
    cols.update(accession=F.col("record_id"), protein_families=F.col("family"),
                sequence=F.col("seq"), ft_mod_res=F.col("modified_residue"),
                organism_name=F.col("class"))
    pages = recs.select(*[v.alias(k) for k, v in cols.items()],
                        F.floor(F.col("record_pos") / 100).cast("long").alias("page"))
    path = scratch_path(spark, "pages")
    # one header line per written page file, as the paging client leaves them
    pages.write.partitionBy("page").option("sep", "\t").option("header", True).csv(path)
    got = tables.read_paged_tsv(spark, path, top_n=450)
    return got.select("accession", "page", "protein_families",
                      F.md5("sequence").alias("seq_md5"), "ft_mod_res")


@query("read_row_range", """SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 400""")
def q_read_row_range(spark, sf):
    from residuum.session import data_path
    r = tables.read_row_range(spark, data_path(sf, "embeddings"), 100, 400, "vec_id")
    return r.select("vec_id", "label")


def _store(spark, sf):
    e = embedding_rows(spark, sf)
    from residuum.sources.testbed import second_model_embedding
    sp = split.random_split(e.withColumn("record_id", F.col("vec_id").cast("string")), 0.2, SEED)
    m1 = sp.select("record_id", F.col("label").cast("string").alias("class"),
                   F.transform("embedding", lambda x: x.cast("double")).alias("embeddings"),
                   "split", F.lit("m1").alias("model"))
    m2 = sp.select("record_id", F.col("label").cast("string").alias("class"),
                   second_model_embedding().alias("embeddings"), "split",
                   F.lit("m2").alias("model"))
    path = scratch_path(spark, "emb")
    writers.write_embeddings(m1.unionByName(m2), path)
    return path


SPLIT_EMB_SQL = """r AS (SELECT vec_id, label, embedding, row_number() OVER (
        ORDER BY md5(concat('42', ':', CAST(vec_id AS VARCHAR))), CAST(vec_id AS VARCHAR)) AS rn
      FROM embeddings),
sp AS (SELECT *, CASE WHEN rn <= (SELECT ceil(count(*) * 0.2) FROM embeddings) THEN 'test'
                      ELSE 'train' END AS split FROM r)"""


@query("write_embeddings", f"""WITH {SPLIT_EMB_SQL}
SELECT m.model, split, count(*) AS n_rows FROM sp, (VALUES ('m1'), ('m2')) AS m(model) GROUP BY 1, 2""")
def q_write_embeddings(spark, sf):
    back = spark.read.parquet(_store(spark, sf))
    return back.groupBy("model", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("read_embeddings", """SELECT CAST(vec_id AS VARCHAR) AS entry_id, CAST(label AS VARCHAR) AS label,
       len(embedding) AS n_dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS emb_sum
FROM embeddings""")
def q_read_embeddings(spark, sf):
    path = _store(spark, sf)
    e = tables.read_embeddings(spark, path + "/model=m1")
    return e.select("entry_id", "label", F.size("mean_representation").cast("long").alias("n_dim"),
                    (F.round(F.aggregate("mean_representation", F.lit(0.0), lambda a, x: a + x), 4)
                     + F.lit(0.0)).alias("emb_sum"))


@query("write_training_lists", f"""WITH {SITES_SQL},
{FAMILY_CTES},
ch AS (SELECT m.record_id, m.family, substring(m.seq, i * 512 + 1, 512) AS seq,
              m.labels[i * 512 + 1: i * 512 + 512] AS labels
       FROM masks m, unnest(range(0, CAST(ceil(length(m.seq) / 512.0) AS BIGINT))) AS t(i))
SELECT CASE WHEN family IN (SELECT family FROM testf) THEN 'test' ELSE 'train' END AS split,
       count(seq) AS n_seq, count(labels) AS n_label,
       CAST(sum(CASE WHEN length(seq) <> len(labels) THEN 1 ELSE 0 END) AS BIGINT) AS n_misaligned
FROM ch GROUP BY 1""")
def q_write_training_lists(spark, sf):
    s = with_sites(spark, sf)
    sp = split.family_split(s, 0.2, SEED)
    ch = chunk_sequence(sp.select("record_id", "seq", "labels", "split"), 512, "seq", "labels")
    return writers.write_training_table(ch.select("seq", "labels", "split"),
                                        scratch_path(spark, "lists"))


def _hits(spark, sf):
    e = embedding_rows(spark, sf)
    return e.where(F.col("prediction") == 0).select(
        "vec_id", "prediction", F.concat(F.lit("batch"), (F.col("vec_id") % 3).cast("string"))
        .alias("source_file"))


@query("hits_only", f"""WITH {EMB_SQL}
SELECT vec_id FROM emb WHERE prediction = 0""")
def q_hits_only(spark, sf):
    return _hits(spark, sf).select("vec_id")


@query("write_hits", f"""WITH {EMB_SQL}
SELECT concat('batch', vec_id % 3) AS source_file, count(*) AS n_hits FROM emb WHERE prediction = 0
GROUP BY 1""")
def q_write_hits(spark, sf):
    path = scratch_path(spark, "hits")
    writers.write_hits(_hits(spark, sf), path)
    writers.write_hits(_hits(spark, sf), path)  # a rerun replaces
    return spark.read.parquet(path).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_hits"))


@query("append_run_metrics", f"""WITH {EMB_SQL},
runs AS (SELECT 'stand_in' AS model_name, label AS y, prediction AS p FROM emb
         UNION ALL SELECT 'logit_argmax', label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER)
         FROM emb)
SELECT model_name, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n_rows, 16 AS batch_size_train, 3 AS epochs FROM runs GROUP BY model_name""")
def q_append_run_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    e = embedding_rows(spark, sf)
    runs = [("logit_argmax", F.col("prediction")),  # replaced by its rerun below
            ("stand_in", F.col("prediction")), ("logit_argmax", M.argmax(F.col("logits")))]
    for name, pred in runs:
        cm = M.confusion_table(e.select(F.col("label").alias("y"), pred.alias("p")))
        row = M.accuracy(cm).crossJoin(cm.agg(F.sum("n").cast("long").alias("n_rows")))
        writers.append_run_metrics(row.select(
            F.lit(name).alias("model_name"), (F.round("accuracy", 6) + 0.0).alias("accuracy"),
            "n_rows", F.lit(16).alias("batch_size_train"), F.lit(3).alias("epochs")), path, name)
    return spark.read.parquet(path).drop("run_id")


@query("attach_predictions", f"""WITH {EMB_SQL}
SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS prediction,
       round(1.0 / list_sum(list_transform(logits, lambda x: exp(CAST(x AS DOUBLE)
             - CAST(list_max(logits) AS DOUBLE)))), 6) AS prediction_probability FROM emb""")
def q_attach_predictions(spark, sf):
    e = embedding_rows(spark, sf)
    # scores are columns of the same row: pairing cannot slip
    return e.select("vec_id", M.argmax(F.col("logits")).alias("prediction"),
                    (F.round(F.array_max(M.softmax(F.col("logits"))), 6) + 0.0)
                    .alias("prediction_probability"))


@query("class_from_path", f"""WITH {REC_SQL}
SELECT record_id, class FROM rec""")
def q_class_from_path(spark, sf):
    # one folder per class, named by value; the class comes from the path only
    path = _tree(spark, sf, name="by-class")
    r = fasta.read_fasta(spark, path, recursive=True, class_from_folder=True)
    return r.select("record_id", "class")


@query("chunk_sequence_and_labels", f"""WITH {SITES_SQL}
SELECT m.record_id, i AS chunk_id, md5(substring(m.seq, i * 512 + 1, 512)) AS seq_md5,
       md5(array_to_string(m.labels[i * 512 + 1: i * 512 + 512], '')) AS labels_md5
FROM masks m, unnest(range(0, CAST(ceil(length(m.seq) / 512.0) AS BIGINT))) AS t(i)""")
def q_chunk_sequence_and_labels(spark, sf):
    s = with_sites(spark, sf).select("record_id", "seq", "labels")
    ch = chunk_sequence(s, 512, "seq", "labels")
    return ch.select("record_id", F.col("chunk_id").cast("long"), F.md5("seq").alias("seq_md5"),
                     F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), ""))
                     .alias("labels_md5"))
