"""STR1: classify FASTA files as they land, with Structured Streaming.

A file stream of FASTA records (``lineSep='\\n>'``, gzip read as a
stream), the same filter -> encode -> score -> hit transforms as the batch
job, and a Parquet file sink with a checkpoint: each file is processed
exactly once, across restarts; partial results are committed per
micro-batch.  Stateless, append mode.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residuum.plans.classify import score_records
from residuum.streaming.ranges import fasta_range_stream
from residuum.sources.fasta import FASTA_NAME_REGEX, RECORD_SEPARATOR, parse_records, with_lead


def fasta_stream(spark: SparkSession, src_dir: str, name_regex: str = FASTA_NAME_REGEX,
                 max_files_per_trigger: int | None = None):
    """Records of every file that the batch reader takes, dealt out anew (a gzip
    file is one split)."""
    r = (spark.readStream.format("text").option("lineSep", RECORD_SEPARATOR)
         .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = r.load(src_dir).where(F.col("_metadata.file_name").rlike(name_regex)).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parse_records(with_lead(raw).repartition(tasks))


def stream_classify_fasta(spark: SparkSession, src_dir: str, model: PipelineModel,
                          out_dir: str, checkpoint_dir: str, info_filter: str | None = "CR=1",
                          min_length: int = 0, hit_class: int | None = 0,
                          available_now: bool = True, min_probability: float = 0.0, exact_token: bool = False,
                          step_bytes: int | None = None, max_steps: int = 8) -> StreamingQuery:
    """The job as a stream.  With ``step_bytes`` files are read in steps of that size,
    ``max_steps`` of them a trigger (see ``ranges``), and a restart goes on inside a file;
    such a query ends with ``processAllAvailable()`` and ``stop()``, as it takes many
    triggers."""
    if step_bytes:
        recs = fasta_range_stream(spark, src_dir, checkpoint_dir.rstrip("/") + "-steps.json", step_bytes, max_steps)
        available_now = False
    else:
        recs = fasta_stream(spark, src_dir)
    hits = score_records(recs, model, info_filter, min_length, hit_class, min_probability, exact_token)
    w = (hits.writeStream.format("parquet").outputMode("append")
         .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
         .partitionBy("source_file"))
    if available_now:
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime="0 seconds" if step_bytes else "30 seconds")
    return w.start()
