"""Token counts: Arrow batches in, lengths only out.

A text is cut at *safe* boundaries: before a single space between two
non-space characters, where the byte-level pre-tokeniser always starts a new
pre-token, so the counts of the parts add up to the count of the whole. A part
longer than ``PART_BYTES`` is cut again between a letter and a digit (also
always a pre-token boundary). Parts not met before by the task are encoded in
batches balanced by bytes; the count of each is kept, so a frequent word is
encoded once for each task. Special strings hold neither a space nor a digit,
so no cut falls inside one.

Null text counts as empty (0 bytes, 0 tokens). Every input row gives one output
row, repeated rows and null ids included; other columns are not read.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 18      # bytes of text in one call of the encoder
PART_BYTES = 1 << 16       # longer parts are cut again
CACHE_PARTS = 300_000      # counts kept by a task before it starts afresh
CACHED_CHARS = 64          # longer parts are not kept

# Python's \s contains every character that the pre-tokeniser takes as space.
SAFE = re.compile(r"(?<=\S)(?= \S)")
SAFE_INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a ``.json`` file, loaded once for each worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _ENCODERS[path] = tok
    return _ENCODERS[path]


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def safe_parts(text: str, part_bytes: int = PART_BYTES) -> list[str]:
    parts = SAFE.split(text)
    if 4 * len(text) <= part_bytes:
        return parts
    out = []
    for p in parts:
        long = 4 * len(p) > part_bytes and utf8_size(p) > part_bytes
        out.extend(SAFE_INNER.split(p) if long else (p,))
    return out


class Counter:
    """Counts tokens of texts; encodes parts in byte-balanced batches."""

    def __init__(self, path: str):
        self.tok = encoder(path)
        self.known: dict[str, int] = {}

    def encode(self, parts: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        batch, size = [], 0
        for p in parts:
            batch.append(p)
            size += utf8_size(p)
            if size >= BATCH_BYTES:
                self._flush(batch, out)
                batch, size = [], 0
        self._flush(batch, out)
        return out

    def _flush(self, batch: list[str], out: dict[str, int]) -> None:
        if batch:
            for p, e in zip(batch, self.tok.encode_batch_fast(batch, add_special_tokens=False)):
                out[p] = len(e)

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        parts = [safe_parts(t) if t else [] for t in texts]
        new = {p for row in parts for p in row if p not in known}
        fresh = self.encode(list(new))
        if len(known) + len(fresh) > CACHE_PARTS:
            known.clear()
            fresh |= self.encode([p for p in {p for row in parts for p in row} if p not in fresh])
        known.update(fresh)
        out = [sum(map(known.__getitem__, row)) for row in parts]
        for p in [p for p in fresh if len(p) > CACHED_CHARS]:
            del known[p]
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row ``(id, n_bytes, n_tokens)`` for each row of ``docs``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        counter = Counter(tokenizer_path)
        for b in batches:
            t = b.column(1).cast(pa.large_string())
            n_bytes = pc.fill_null(pc.binary_length(t.cast(pa.large_binary())), 0).to_numpy()
            counts, lo = [], 0
            while lo < len(t):  # rows of about 4 MB of text at a time
                hi, size = lo, 0
                while hi < len(t) and (hi == lo or size + n_bytes[hi] <= 4 << 20):
                    size += n_bytes[hi]
                    hi += 1
                counts.extend(counter.count(t.slice(lo, hi - lo).to_pylist()))
                lo = hi
            yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()),
                                   pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint") \
        .withColumnRenamed("id", id_col)
