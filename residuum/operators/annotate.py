"""Header and annotation columns: ids, labels, PTM sites, class codes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions.digests import NO_VALUE


def entry_id(header: Column) -> Column:
    """PRJ1: first whitespace-separated word of a header."""
    return F.split(F.trim(header), r"\s+")[0]


def class_from_path(path: Column) -> Column:
    """PRJ2: the class folder a file was read from (``.../<class>/<file>``);
    a ``key=value`` folder name (Spark partition layout) yields ``value``."""
    return F.regexp_extract(path, r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)


def keyword_label(header: Column, keywords: Sequence[str]) -> Column:
    """PRJ3: last keyword (in list order) contained in the lower-cased
    header; ``''`` when none is.  So with ``[x1, x13]`` a header holding
    ``x13`` is labelled ``x13`` because both match and the later wins."""
    hits = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]),
                    lambda w: F.contains(F.lower(header), w))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(""))


def mod_res_positions(mod_res: Column) -> Column:
    """PRJ4: 1-based positions after ``MOD_RES ``; a range gives its start;
    a null annotation gives no positions."""
    # fixed value: the feature name of a modified residue in annotations
    found = F.regexp_extract_all(mod_res, F.lit(r"MOD_RES (\d+)"), F.lit(1))
    return F.coalesce(F.transform(found, lambda x: x.cast("int")),
                      F.array().cast("array<int>"))


def ptm_mask(seq: Column, positions: Column, packed: bool = False) -> Column:
    """PRJ5: 0/1 array as long as the sequence, 1 at the listed positions.

    Positions outside ``1..length`` are ignored here and reported by
    ``ptm_rejects``; an empty sequence gives an empty mask.  ``packed`` gives
    the same values one byte each (``digests.list_parts``).
    """
    n = F.length(seq)
    if packed:
        return _packed_mask(n, positions)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n),
                                     lambda i: F.array_contains(positions, i).cast("int"))
                  ).otherwise(F.array().cast("array<int>"))


def _packed_mask(length: Column, positions: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def _mask(lengths: pa.Array, positions: pa.Array) -> pa.Array:
        out = []
        for n, found in zip(lengths.to_pylist(), positions.to_pylist()):
            # a position that is not listed is unknown where the list has a null
            row = np.full(n or 0, NO_VALUE if found is None or None in found else 0, dtype=np.int8)
            for p in found or ():
                if p is not None and 1 <= p <= len(row):
                    row[p - 1] = 1
            out.append(row.tobytes())
        return pa.array(out, pa.binary())

    return _mask(length, positions)


def ptm_rejects(df: DataFrame, id_col: str, seq_col: str, pos_col: str) -> DataFrame:
    """Positions that do not fall on the sequence, with a reason."""
    e = df.select(id_col, F.length(seq_col).alias("seq_len"),
                  F.explode(pos_col).alias("position"))
    bad = e.where((F.col("position") < 1) | (F.col("position") > F.col("seq_len")))
    return bad.withColumn("reason", F.when(F.col("position") < 1, F.lit("position below 1"))
                          .otherwise(F.lit("position past sequence end")))


def class_dictionary(df: DataFrame, class_col: str = "class") -> DataFrame:
    """PRJ13 dictionary: each distinct non-null class and its 0-based rank
    in lexicographic order (``c1, c10, c11, c2, ...``).

    The window runs over the distinct classes only; AQE broadcasts the
    table back if it measures it small.
    """
    classes = df.where(F.col(class_col).isNotNull()).select(class_col).distinct()
    codes = classes.withColumn("code", (F.row_number().over(Window.orderBy(class_col)) - 1)
                               .cast("int"))
    return codes


def class_code(df: DataFrame, class_col: str = "class", dictionary: DataFrame | None = None,
               out: str = "code") -> DataFrame:
    """PRJ13: class -> code through the dictionary; missing -> -1."""
    d = dictionary if dictionary is not None else class_dictionary(df, class_col)
    d = d.select(F.col(class_col).alias("_cls"), F.col("code").alias("_code"))
    return (df.join(d, df[class_col] == d["_cls"], "left")
              .withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)))
              .drop("_cls", "_code"))


def class_decode(df: DataFrame, dictionary: DataFrame, code_col: str = "code",
                 class_col: str = "class", out: str = "decoded") -> DataFrame:
    """PRJ14: code -> class name with the fitted dictionary (unknown -> null)."""
    d = dictionary.select(F.col("code").alias("_c"), F.col(class_col).alias(out))
    return df.join(d, df[code_col] == d["_c"], "left").drop("_c")


def header_length_filter(df: DataFrame, info_filter: str | None, min_length: int,
                         header_col: str = "description", seq_col: str = "seq",
                         exact_token: bool = False) -> DataFrame:
    """FLT1: header contains ``info_filter`` (plain substring, so ``CR=1``
    also passes ``CR=10``; ``exact_token`` asks for a whole token) and
    sequence length >= ``min_length``.  Both are plain predicates, so they
    sit below any scoring UDF in the plan."""
    cond = F.length(seq_col) >= F.lit(int(min_length))
    if info_filter:
        if exact_token:
            import re
            cond = cond & F.col(header_col).rlike(r"(^|\s)" + re.escape(info_filter) + r"(\s|$)")
        else:
            cond = cond & F.contains(F.col(header_col), F.lit(info_filter))
    return df.where(cond)
