"""Small tables for the operators: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, alphabet="abcdefgh", size=5) -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, size))) for _ in range(n))


def documents(spark, texts, lang="en"):
    """``texts``: list of texts, or of (doc_id, text)."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)


def table_dir(tmp_path, **frames) -> str:
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def query(name):
    import __spark_entry__ as entry
    found = [k for k in entry.queries() if k == name or k.startswith(name + "_")]
    return entry.queries()[found[0]]
