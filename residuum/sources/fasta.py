"""FASTA sources: one file, a list of files, or a whole folder tree.

A record is everything between two ``\\n>`` separators, so Spark's text
source splits plain files across tasks on record boundaries.  An Arrow pass
marks the first row of each file; the parsing is SQL.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators.annotate import class_from_path, entry_id

# File-name patterns of the two folder scanners.
FASTA_GZ_REGEX = r"^.*\.fasta\.gz$"
PROTEIN_DUMP_REGEX = r"^mgy_proteins_.*\.fa\.gz$"

# every FASTA file name that the readers, batch and stream, take
FASTA_NAME_REGEX = r"^.*\.(fa|fasta)(\.gz)?$"

RECORD_SEPARATOR = "\n>"

# file positions of gzip members sort after those of plain files
GZIP_OFFSET = 1 << 62


def _mark_lead(batches):
    """Adds ``lead``: whether a row is the first of its file. Rows arrive in file
    order within a task, and only a file's first block starts at 0."""
    last = None
    for b in batches:
        files = b.column(b.schema.get_field_index("source_file"))
        before = pa.concat_arrays([pa.array([last], files.type), files.slice(0, max(0, len(files) - 1))]) \
            if len(files) else files
        new = pc.fill_null(pc.not_equal(files, before), True)
        first_block = pc.equal(b.column(b.schema.get_field_index("_block")), 0)
        last = files[-1].as_py() if len(files) else last
        yield b.append_column("lead", pc.and_(new, first_block))


def with_lead(raw: DataFrame) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields)
    return raw.mapInArrow(_mark_lead, f"{fields}, lead boolean").drop("_block")


def parse_records(raw: DataFrame, value: str = "value") -> DataFrame:
    """Split raw record text into ``description`` and ``seq``.

    The first record of a file (``lead``) still carries its ``>``; ``\\r`` line
    ends and any whitespace inside the sequence are dropped; a ``>`` inside a
    header is kept.  A record without a header is kept with id ``''``; text
    before the first ``>`` of a file is not a record (see ``fasta_rejects``).
    """
    text = F.when(F.col("lead"), F.substring(F.col(value), F.lit(2), F.length(value))).otherwise(F.col(value))
    header = F.regexp_replace(F.regexp_extract(text, r"^([^\n]*)", 1), r"\r$", "")
    body = F.regexp_replace(text, r"^[^\n]*\n?", "")
    cols = [c for c in raw.columns if c not in (value, "lead")]
    out = raw.where(~F.col("lead") | F.startswith(F.col(value), F.lit(">"))).select(
        *cols, header.alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return out.select(entry_id(F.col("description")).alias("record_id"),
                      entry_id(F.col("description")).alias("record_name"),
                      "description", "seq", *cols)


def reject_rows(raw: DataFrame) -> DataFrame:
    """``(source_file, reason, text)``: text before the first record (left out),
    and records without a header (kept, with id ``''``)."""
    lead_text = F.col("lead") & ~F.startswith(F.col("value"), F.lit(">"))
    header = F.regexp_extract(F.when(F.col("lead"), F.expr("substring(value, 2)")).otherwise(F.col("value")),
                              r"^([^\n]*)", 1)
    reason = F.when(lead_text & (F.length(F.trim(F.regexp_replace("value", r"\s", ""))) > 0),
                    F.lit("text before the first record")) \
        .when(~lead_text & (F.length(F.regexp_replace(header, r"\s", "")) == 0), F.lit("record without a header"))
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull()) \
        .select("source_file", "reason", F.col("value").alias("text"))


def raw_records(spark: SparkSession, paths, recursive: bool = False, path_glob: str | None = None,
                file_regex: str | None = None) -> DataFrame:
    """Record text with ``source_file``, ``record_pos`` (monotone within a file)
    and ``lead``.  A gzip file is one split, however large, so the rows of
    gzip files are dealt out anew; plain files keep their splits."""
    r = spark.read.option("lineSep", RECORD_SEPARATOR)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    raw, name = r.text(paths), F.col("_metadata.file_name")
    if file_regex:
        raw = raw.where(name.rlike(file_regex))
    zipped = F.endswith(F.lower(name), F.lit(".gz"))

    def rows(part: DataFrame, offset: int) -> DataFrame:
        return with_lead(part.select(
            "value", F.col("_metadata.file_path").alias("source_file"),
            (F.monotonically_increasing_id() + F.lit(offset)).alias("record_pos"),
            F.col("_metadata.file_block_start").alias("_block")))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows(raw.where(~zipped), 0).unionByName(rows(raw.where(zipped), GZIP_OFFSET).repartition(tasks))


def read_fasta(spark: SparkSession, paths, recursive: bool = False,
               path_glob: str | None = None, file_regex: str | None = None,
               class_from_folder: bool = False) -> DataFrame:
    """SRC1 (+ SRC2 options): FASTA records with their file and position.

    ``source_file`` and ``record_pos`` give "first" a meaning downstream;
    ``class_from_folder`` adds PRJ2's class.
    """
    out = parse_records(raw_records(spark, paths, recursive, path_glob, file_regex))
    if class_from_folder:
        out = out.withColumn("class", class_from_path(F.col("source_file")))
    return out


def fasta_rejects(spark: SparkSession, paths, recursive: bool = False, file_regex: str | None = None) -> DataFrame:
    """What ``read_fasta`` leaves out or reads without an id, and why."""
    return reject_rows(raw_records(spark, paths, recursive, file_regex=file_regex))


def scan_fasta_tree(spark: SparkSession, root: str, name_regex: str = FASTA_GZ_REGEX,
                    class_from_folder: bool = True, range_bytes: int | None = None) -> DataFrame:
    """SRC2: every file under ``root`` whose name matches ``name_regex``.  With
    ``range_bytes`` large files are cut into ranges of about that size, gzip files
    between their members, and each range is read by a task of its own."""
    if range_bytes:
        from residuum.sources.ranges import raw_ranges
        out = parse_records(raw_ranges(spark, root, name_regex, range_bytes))
        return out.withColumn("class", class_from_path(F.col("source_file"))) if class_from_folder else out
    return read_fasta(spark, root, recursive=True, file_regex=name_regex,
                      class_from_folder=class_from_folder)


def resolve_input(path: str) -> str:
    """SRC3: ``.../`` is a folder tree, ``*.fa.gz`` / ``*.fasta(.gz)`` one
    file; anything else is an error (not an empty result)."""
    if path.endswith("/"):
        return "tree"
    if path.endswith((".fa.gz", ".fasta.gz", ".fa", ".fasta")):
        return "file"
    raise ValueError(f"not a folder (ending '/') or a FASTA file: {path!r}")


def read_fasta_input(spark: SparkSession, path: str, name_regex: str = FASTA_NAME_REGEX,
                     class_from_folder: bool = True) -> DataFrame:
    """SRC3: read a single file or a whole tree depending on the path."""
    if resolve_input(path) == "tree":
        return scan_fasta_tree(spark, path, name_regex, class_from_folder)
    return read_fasta(spark, path, class_from_folder=class_from_folder)


def wrapped_fasta(header: Column, seq: Column, width: int = 60) -> Column:
    """Record text: ``>header``, then the sequence in lines of ``width``."""
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.when(F.length(seq) > 0, F.concat(F.lit(">"), header, F.lit("\n"), body)).otherwise(
        F.concat(F.lit(">"), header))
