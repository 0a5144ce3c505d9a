"""ML9: classify every record of a FASTA folder (or one file) and keep hits.

One lazy plan per input: read -> header/length filter (below the encoder)
-> encode once (rows of gzip files are dealt out anew by the reader) -> score
-> keep the hit class -> one partition per input file.  The streaming twin in
``residuum.streaming`` runs the same ``score_records`` on a file stream.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.operators.annotate import header_length_filter
from residuum.operators.embed import embed_sequences
from residuum.operators.models import score_shallow
from residuum.sinks.writers import write_hits
from residuum.sources.fasta import read_fasta_input

HIT_COLUMNS = ["record_id", "prediction", "info", "prediction_probability", "sequence",
               "source_file"]


def score_records(recs: DataFrame, model: PipelineModel, info_filter: str | None = "CR=1",
                  min_length: int = 0, hit_class: int | None = 0, min_probability: float = 0.0,
                  exact_token: bool = False) -> DataFrame:
    """Filter, encode, score and keep the hit class (FLT1 -> ML1 -> ML4 -> FLT2).

    ``hit_class=None`` keeps every class; ``min_probability`` keeps records
    whose predicted class has at least that probability.  The probability
    vector stays an array. ``exact_token`` takes ``info_filter`` as a whole header
    token (``CR=1`` is then not in ``CR=12``)."""
    kept = header_length_filter(recs, info_filter, min_length, exact_token=exact_token)
    hits = score_shallow(model, embed_sequences(kept))
    if hit_class is not None:
        hits = hits.where(F.col("prediction") == F.lit(hit_class))
    if min_probability:
        hits = hits.where(F.array_max("prediction_probability") >= F.lit(min_probability))
    return hits.select("record_id", "prediction", F.col("description").alias("info"),
                       "prediction_probability", F.col("seq").alias("sequence"), "source_file")


def classify_fasta(spark: SparkSession, path: str, model: PipelineModel, out_path: str | None,
                   info_filter: str | None = "CR=1", min_length: int = 0,
                   hit_class: int | None = 0, min_probability: float = 0.0, exact_token: bool = False) -> DataFrame:
    recs = read_fasta_input(spark, path, class_from_folder=False).drop("record_pos")
    hits = score_records(recs, model, info_filter, min_length, hit_class, min_probability, exact_token)
    if out_path:
        write_hits(hits, out_path)
    return hits
