"""Annotation and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from residuum.functions.residues import ESM_TOKENS, residue_letters
from residuum.operators import annotate, balance, tokens
from residuum.plans.registry import query
from residuum.sources.testbed import REC_SQL, read_table, records

SEED = 42
# Keywords for the label scan; later entries win, and several are prefixes
# of later ones (as ``cas1`` is of ``cas13``).
KEYWORDS = ["th", "the", "ther", "en", "ent", "ou", "our"]


def _csv(c):
    return F.array_join(c.cast("array<string>"), ",")


def _cat(c):
    return F.array_join(c.cast("array<string>"), "")


def _kw_sql(col):
    arr = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
    return f"coalesce(list_filter({arr}, lambda w: contains(lower({col}), w))[-1], '')"


# token id of a residue letter: ids 4..30 are the single-letter tokens in order
LETTERS = "".join(t for t in ESM_TOKENS[4:31])


def _ids_sql(seq):
    letters = f"list_transform(string_split({seq}, ''), lambda c: 3 + instr('{LETTERS}', c))"
    return f"CASE WHEN length(seq) = 0 THEN [0, 2] ELSE list_concat([0], {letters}, [2]) END"


IDS_SQL = _ids_sql("seq")
# the cut is the feature of ``tokenize_residues`` alone
CUT_IDS_SQL = _ids_sql("substring(seq, 1, 1024)")


def with_sites(spark, sf, packed=False):
    r = records(spark, sf)
    return r.withColumn("positions", annotate.mod_res_positions(F.col("modified_residue"))) \
            .withColumn("labels", annotate.ptm_mask(F.col("seq"), F.col("positions"), packed))


SITES_SQL = REC_SQL + """,
sites AS (SELECT *, list_transform(regexp_extract_all(modified_residue, 'MOD_RES (\\d+)', 1),
                                   lambda x: CAST(x AS INTEGER)) AS positions FROM rec),
masks AS (SELECT *, list_transform(range(1, length(seq) + 1),
                    lambda i: CASE WHEN list_contains(positions, i) THEN 1 ELSE 0 END) AS labels
          FROM sites)"""


@query("entry_id", f"""WITH {REC_SQL}
SELECT record_pos, string_split_regex(trim(description), '\\s+')[1] AS entry_id FROM rec""")
def q_entry_id(spark, sf):
    return records(spark, sf).select("record_pos",
                                     annotate.entry_id(F.col("description")).alias("entry_id"))


@query("keyword_label", f"""SELECT doc_id, {_kw_sql('text')} AS label FROM documents""")
def q_keyword_label(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", annotate.keyword_label(F.col("text"), KEYWORDS).alias("label"))


@query("mod_res_positions", f"""WITH {SITES_SQL}
SELECT record_id, array_to_string(positions, ',') AS positions FROM sites""")
def q_mod_res_positions(spark, sf):
    return with_sites(spark, sf).select("record_id", _csv(F.col("positions")).alias("positions"))


@query("ptm_mask", f"""WITH {SITES_SQL}
SELECT record_id, len(labels) AS mask_len, CAST(coalesce(list_sum(labels), 0) AS BIGINT) AS n_sites,
       md5(array_to_string(labels, '')) AS mask_md5 FROM masks""")
def q_ptm_mask(spark, sf):
    return with_sites(spark, sf).select(
        "record_id", F.size("labels").cast("long").alias("mask_len"),
        F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_sites"),
        F.md5(_cat(F.col("labels"))).alias("mask_md5"))


@query("ptm_rejects", f"""WITH {SITES_SQL}
SELECT record_id, p AS position,
       CASE WHEN p < 1 THEN 'position below 1' ELSE 'position past sequence end' END AS reason
FROM sites, unnest(positions) AS t(p) WHERE p < 1 OR p > length(seq)""")
def q_ptm_rejects(spark, sf):
    return annotate.ptm_rejects(with_sites(spark, sf), "record_id", "seq", "positions").select(
        "record_id", "position", "reason")


CLASS_NULL_SQL = REC_SQL + """,
rc AS (SELECT record_id, record_pos, CASE WHEN record_pos % 17 = 0 THEN NULL ELSE class END AS class
       FROM rec),
dict AS (SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT class FROM rc WHERE class IS NOT NULL))"""


def _class_with_nulls(spark, sf):
    r = records(spark, sf)
    return r.select("record_id", "record_pos",
                    F.when(F.col("record_pos") % 17 == 0, F.lit(None)).otherwise(
                        F.col("class")).alias("class"))


@query("class_code", f"""WITH {CLASS_NULL_SQL}
SELECT rc.record_id, rc.class, coalesce(dict.code, -1) AS code FROM rc LEFT JOIN dict USING (class)""")
def q_class_code(spark, sf):
    return annotate.class_code(_class_with_nulls(spark, sf)).select("record_id", "class", "code")


@query("class_decode", f"""WITH {CLASS_NULL_SQL},
coded AS (SELECT rc.record_id, coalesce(dict.code, -1) AS code FROM rc LEFT JOIN dict USING (class))
SELECT coded.record_id, coded.code, dict.class AS decoded FROM coded LEFT JOIN dict USING (code)""")
def q_class_decode(spark, sf):
    rc = _class_with_nulls(spark, sf)
    dic = annotate.class_dictionary(rc)
    coded = annotate.class_code(rc, dictionary=dic)
    return annotate.class_decode(coded, dic).select("record_id", "code", "decoded")


@query("header_length_filter", f"""WITH {REC_SQL}
SELECT record_id FROM rec WHERE contains(description, 'CR=1') AND length(seq) >= 100""")
def q_header_length_filter(spark, sf):
    return annotate.header_length_filter(records(spark, sf), "CR=1", 100).select("record_id")


# ------------------------------------------------------------------ tokens


@query("truncate_labels", f"""WITH {SITES_SQL}
SELECT record_id, len(labels[1:512]) AS n_labels,
       CAST(coalesce(list_sum(labels[1:512]), 0) AS BIGINT) AS n_sites FROM masks""")
def q_truncate_labels(spark, sf):
    t = with_sites(spark, sf).select("record_id", tokens.truncate_labels(F.col("labels"), 512)
                                     .alias("l"))
    return t.select("record_id", F.size("l").cast("long").alias("n_labels"),
                    F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_sites"))


def tokenized(spark, sf, max_length=None, packed=False):
    return records(spark, sf, residue_letters).withColumn(
        "input_ids", tokens.tokenize_residues(F.col("seq"), max_length, add_special=True, packed=packed))


@query("tokenize_residues", f"""WITH {REC_SQL},
tok AS (SELECT record_id, {CUT_IDS_SQL} AS input_ids FROM rec)
SELECT record_id, len(input_ids) AS n_tokens, CAST(list_sum(input_ids) AS BIGINT) AS id_sum,
       md5(array_to_string(input_ids, ',')) AS ids_md5 FROM tok""")
def q_tokenize_residues(spark, sf):
    t = tokenized(spark, sf, 1024)
    return t.select("record_id", F.size("input_ids").cast("long").alias("n_tokens"),
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
                    .alias("id_sum"),
                    F.md5(_csv(F.col("input_ids"))).alias("ids_md5"))


@query("assign_batches", f"""WITH {REC_SQL}
SELECT record_id, source_file,
       (row_number() OVER (PARTITION BY source_file ORDER BY record_pos) - 1) // 25 AS batch_id
FROM rec""")
def q_assign_batches(spark, sf):
    r = records(spark, sf).select("record_id", "record_pos", "source_file")
    return tokens.assign_batches(r, 25, "source_file").select("record_id", "source_file", "batch_id")


PAD_SQL = REC_SQL + f""",
tok AS (SELECT record_id, {IDS_SQL} AS input_ids,
               (row_number() OVER (ORDER BY record_pos) - 1) // 8 AS batch_id FROM rec),
pad AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch_id) - len(input_ids) AS n_pad FROM tok)"""


def padded(spark, sf):
    return tokens.pad_batch(tokenized(spark, sf), 8)


@query("pad_batch", f"""WITH {PAD_SQL}
SELECT record_id, batch_id, len(input_ids) + n_pad AS padded_len, n_pad FROM pad""")
def q_pad_batch(spark, sf):
    p = padded(spark, sf)
    return p.select("record_id", "batch_id", F.size("input_ids").cast("long").alias("padded_len"),
                    F.size(F.filter("attention_mask", lambda m: m == 0)).cast("long")
                    .alias("n_pad"))


@query("active_positions", f"""WITH {PAD_SQL}
SELECT record_id, len(input_ids) AS n_active, n_pad AS n_ignored FROM pad""")
def q_active_positions(spark, sf):
    p = padded(spark, sf).withColumn(
        "labels", tokens.active_positions(F.col("attention_mask"), F.col("input_ids")))
    return p.select("record_id",
                    F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_active"),
                    F.size(F.filter("labels", lambda x: x == -100)).cast("long")
                    .alias("n_ignored"))


MLM_SQL = REC_SQL + f""",
tok AS (SELECT record_id, {IDS_SQL} AS ids FROM rec),
pos AS (SELECT record_id, ids,
          list_transform(ids, lambda t, i: struct_pack(
            t := t,
            ch := NOT list_contains([0, 2, 1], t),
            d := md5(concat('42', ':', record_id, ':', i - 1)))) AS h
        FROM tok),
drawn AS (SELECT record_id, ids, list_transform(h, lambda x: struct_pack(
            t := x.t, ch := x.ch AND x.d < '26666666', u := substring(x.d, 9, 8),
            r := CAST(('0x' || substring(x.d, 17, 8)) AS BIGINT) % 33)) AS p
          FROM pos),
mlm AS (SELECT record_id, ids,
          list_transform(p, lambda x: CASE WHEN x.ch THEN x.t ELSE -100 END) AS labels,
          list_transform(p, lambda x: CASE WHEN NOT x.ch THEN x.t
                                           WHEN x.u < 'cccccccc' THEN 32
                                           WHEN x.u < 'e6666666' THEN CAST(x.r AS INTEGER)
                                           ELSE x.t END) AS input_ids
        FROM drawn)"""


def masked(spark, sf, ignore_others=True):
    """Masked corpus; labels and ids are packed."""
    return tokens.mlm_mask(tokenized(spark, sf, packed=True), seed=SEED, ignore_others=ignore_others)


@query("mlm_mask", f"""WITH {MLM_SQL}
SELECT record_id, len(list_filter(labels, lambda x: x <> -100)) AS n_targets,
       md5(array_to_string(labels, ',')) AS labels_md5,
       md5(array_to_string(input_ids, ',')) AS ids_md5 FROM mlm""")
def q_mlm_mask(spark, sf):
    m = masked(spark, sf)
    return m.select("record_id", tokens.n_targets(F.col("labels")).alias("n_targets"),
                    tokens.ids_md5(F.col("labels")).alias("labels_md5"),
                    tokens.ids_md5(F.col("input_ids")).alias("ids_md5"))


@query("mlm_labels_copy", f"""WITH {MLM_SQL},
copies AS (SELECT record_id, {IDS_SQL} AS ids FROM rec)
SELECT record_id, md5(array_to_string(copies.ids, ',')) AS labels_md5, md5(array_to_string(mlm.input_ids, ',')) AS ids_md5
FROM copies JOIN mlm USING (record_id)""")
def q_mlm_labels_copy(spark, sf):
    """Every position keeps its own id as label while the ids are masked."""
    m = masked(spark, sf, ignore_others=False)
    return m.select("record_id", tokens.ids_md5(F.col("labels")).alias("labels_md5"),
                    tokens.ids_md5(F.col("input_ids")).alias("ids_md5"))


@query("ignore_index", f"""WITH {MLM_SQL}
SELECT record_id, len(list_filter(labels, lambda x: x <> -100)) AS n_kept,
       CAST(coalesce(list_sum(list_filter(labels, lambda x: x <> -100)), 0) AS BIGINT) AS label_sum
FROM mlm""")
def q_ignore_index(spark, sf):
    m = masked(spark, sf).withColumn("kept", tokens.ignore_index(F.col("labels"), F.col("input_ids"),
                                                                  packed=True))
    return m.select("record_id", F.size("kept").cast("long").alias("n_kept"),
                    F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["label"])
                    .alias("label_sum"))


@query("token_class_weights", f"""WITH {SITES_SQL},
t AS (SELECT CAST(sum(len(labels)) AS BIGINT) AS n, CAST(sum(list_sum(labels)) AS BIGINT) AS n1
      FROM masks)
SELECT 0 AS label, n - n1 AS n_label, round(n / (2.0 * (n - n1)), 6) AS weight FROM t
UNION ALL
SELECT 1 AS label, n1 AS n_label, round(n / (2.0 * n1), 6) AS weight FROM t""")
def q_token_class_weights(spark, sf):
    w = balance.token_class_weights(with_sites(spark, sf), "labels")
    return w.withColumn("weight", F.round("weight", 6))
