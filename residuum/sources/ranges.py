"""FASTA records of a byte range of a file: plain, or gzip of one or many members.

A range ``[lo, hi)`` of the stored bytes owns a stretch of the text, and the records
whose separator (``\\n>``) begins there, the file's first record for ``lo = 0``.  Ranges
of a file are read apart from each other and give every record once:

* ``plain``: the bytes themselves;
* ``members``: gzip members (as in block-compressed files) that begin in the range; the
  first is found by its header and proved by its checksum, the rest follow one another;
* ``prefix``: what decompressing gives while the range's bytes are fed, from the start of
  the file on, for gzip files of one member, into which nothing can seek.

Files are opened with Arrow's file systems, so local, HDFS and object-store paths work.
A record is the largest thing in memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
SEPARATOR = b"\n>"
BATCH_BYTES = 4 << 20
RAW = "value string, source_file string, record_pos long, lead boolean"
RANGE_BYTES = 64 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"file:(//(?=/))?(?=/)", path)
    if local:
        return pafs.LocalFileSystem(), path[local.end():]
    return pafs.FileSystem.from_uri(path)


def open_file(path: str):
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def _fed(f, at: int, hi: int | None = None) -> Iterator[tuple[int, bytes]]:
    """``(position, bytes)`` from ``at`` on, cut at multiples of ``CHUNK``."""
    f.seek(at)
    while hi is None or at < hi:
        data = f.read(CHUNK - at % CHUNK if hi is None else min(CHUNK - at % CHUNK, hi - at))
        if not data:
            return
        yield at, data
        at += len(data)


def _is_member(f, at: int) -> bool:
    """Whether a whole gzip member with a right checksum begins at ``at``."""
    inflate = zlib.decompressobj(31)
    try:
        for _, data in _fed(f, at):
            while data:
                inflate.decompress(data, CHUNK * 16)
                data = inflate.unconsumed_tail
                if inflate.eof:
                    return True
    except zlib.error:
        pass
    return False


def first_member(f, lo: int, hi: int) -> int | None:
    """Position of the first gzip member that begins in ``[lo, hi)``."""
    if lo == 0:
        return 0
    window, start = b"", lo
    for at, data in _fed(f, lo, hi + len(MAGIC)):
        window, start = window[-(len(MAGIC) - 1):] + data, at - min(len(window), len(MAGIC) - 1)
        found = window.find(MAGIC)
        while found >= 0 and start + found < hi:
            if _is_member(f, start + found):
                return start + found
            found = window.find(MAGIC, found + 1)
        f.seek(at + len(data))
    return None


def _inflated(f, at: int) -> Iterator[tuple[int, int, bytes]]:
    """``(member start, position of the bytes fed, text)`` from the member at ``at`` on."""
    inflate, member = zlib.decompressobj(31), at
    for position, data in _fed(f, at):
        while data:
            if inflate.eof:  # a member ended: the next begins, maybe after padding
                left = data.lstrip(b"\0")
                if not left:
                    break
                member = position + len(data) - len(left)
                position, data, inflate = member, left, zlib.decompressobj(31)
            size = len(data)
            text = inflate.decompress(data)
            yield member, position, text
            data = inflate.unused_data if inflate.eof else b""
            position += size - len(data)


def _owned(path: str, mode: str, lo: int, hi: int) -> Iterator[tuple[bytes, bool]]:
    """Text of a range in pieces with true, then what follows it with false."""
    with open_file(path) as f:
        if mode == "plain":
            for at, data in _fed(f, lo):
                for piece, own in ((data[:max(0, hi - at)], True), (data[max(0, hi - at):], False)):
                    if piece:
                        yield piece, own
        elif mode == "members":
            start = first_member(f, lo, hi)
            if start is not None:
                for member, _, text in _inflated(f, start):
                    yield text, member < hi
        else:
            for _, at, text in _inflated(f, 0):
                if at >= lo:
                    yield text, at < hi


def cut_records(pieces: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[tuple[bytes, bool]]:
    """``(record, lead)``: records whose separator begins in the pieces marked true; the
    text that the file begins with is one too if ``first`` (``lead``)."""
    buffer, base, limit, scan = bytearray(), 0, 0, 0
    inside = lead = first
    for piece, own in pieces:
        limit += len(piece) if own else 0
        buffer += piece
        while (at := buffer.find(SEPARATOR, scan)) >= 0:
            if inside:
                yield bytes(buffer[:at]), lead
            if base + at >= limit:
                return
            inside, lead = True, False
            del buffer[:at + len(SEPARATOR)]
            base, scan = base + at + len(SEPARATOR), 0
        if not inside:
            if not own and base + len(buffer) > limit:
                return
            drop = max(0, len(buffer) - 1)
            del buffer[:drop]
            base += drop
        scan = max(0, len(buffer) - 1)
    if inside and buffer:
        yield bytes(buffer), lead


def range_batches(path: str, mode: str, lo: int, hi: int, number: int) -> Iterator[pa.RecordBatch]:
    """The records of a range as Arrow batches of about ``BATCH_BYTES``; ``record_pos`` is
    ``number`` in the high bits and a count in the low 32."""
    values, leads, size, base = [], [], 0, number << 32

    def batch():
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array([v.decode("utf-8", "replace") for v in values], pa.string()), pa.array([path] * n, pa.string()),
             pa.array(range(base, base + n), pa.int64()), pa.array(leads, pa.bool_())],
            names=["value", "source_file", "record_pos", "lead"])

    for value, lead in cut_records(_owned(path, mode, lo, hi), lo == 0):
        values.append(value)
        leads.append(lead)
        size += len(value)
        if size >= BATCH_BYTES:
            yield batch()
            base, size = base + len(values), 0
            values.clear()
            leads.clear()
    if values:
        yield batch()


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            yield from range_batches(row["path"], row["mode"], row["lo"], row["hi"], row["k"])


def raw_ranges(spark: SparkSession, root: str, name_regex: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw records (as ``fasta.raw_records``) of all files under ``root``, each cut into
    ranges that are read by tasks of their own.  Files are listed by Spark (names and
    sizes only); gzip files are cut between members."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length") \
        .where(F.element_at(F.split("path", "/"), -1).rlike(name_regex) & (F.col("length") > 0))
    count = F.ceil(F.col("length") / range_bytes).cast("long")
    mode = F.when(F.endswith(F.lower("path"), F.lit(".gz")), "members").otherwise("plain")
    cut = files.select("path", "length", mode.alias("mode"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))
    cut = cut.select("path", "mode", "k", (F.col("k") * range_bytes).alias("lo"),
                     F.least(F.col("length"), (F.col("k") + 1) * range_bytes).alias("hi"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, "path", "k").mapInArrow(_read_ranges, RAW)
