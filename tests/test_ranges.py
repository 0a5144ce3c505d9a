"""Files in ranges: batch and stream against the plain reader."""

from __future__ import annotations

import glob
import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from residuum.sources import fasta, ranges
from residuum.streaming.ranges import fasta_range_stream, file_mode


def block(data: bytes) -> bytes:
    """A gzip member with its size in the header, as block compressors write it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def text(seed: int, n: int = 400) -> bytes:
    rng = random.Random(seed)
    records = [f">r{seed}_{i} d>{i}\n" + "\n".join("".join(rng.choices("ACDEFGHIKL", k=60)) for _ in range(rng.randint(0, 12)))
               for i in range(n)]
    return "\n".join(records).encode() + b"\n"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    a, b, c, d = (text(k) for k in range(4))
    cuts = [a[i:i + 1000] for i in range(0, len(a), 1000)]
    (root / "a.fa.gz").write_bytes(b"".join(map(block, cuts)) + block(b""))
    (root / "b.fasta.gz").write_bytes(b"".join(gzip.compress(b[i:i + 7777]) for i in range(0, len(b), 7777)))
    (root / "c.fa.gz").write_bytes(gzip.compress(c))
    (root / "d.fasta").write_bytes(b"; note\n" + d)
    (root / "e.fa").write_bytes(b"")
    (root / "skip.txt").write_bytes(b">no\nM\n")
    return f"file://{root}/"


KEY = ["record_id", "description", "seq", "source_file"]


def rows(df):
    return sorted((r.record_id, r.description, r.seq, r.source_file.rsplit("/", 1)[1]) for r in df.select(*KEY).collect())


@pytest.mark.parametrize("size", [700, 5_000, 1 << 20])
def test_ranges_equal_whole_files(spark, tree, size):
    whole = fasta.scan_fasta_tree(spark, tree, fasta.FASTA_NAME_REGEX, class_from_folder=False)
    cut = fasta.scan_fasta_tree(spark, tree, fasta.FASTA_NAME_REGEX, class_from_folder=False, range_bytes=size)
    assert rows(cut) == rows(whole) and cut.count() == 1600
    by_file = cut.where(F.endswith("source_file", F.lit("a.fa.gz"))).orderBy("record_pos").collect()
    assert [r.record_id for r in by_file] == [f"r0_{i}" for i in range(400)]


def test_several_tasks_read_one_file(spark, tree):
    raw = ranges.raw_ranges(spark, tree, r"^a\.fa\.gz$", 5_000)
    assert raw.select(F.spark_partition_id()).distinct().count() > 2


def test_false_member_starts_are_refused(tmp_path):
    """Stored bytes that look like a header, also one whose member is cut short."""
    fake = ranges.MAGIC + b"\0" * 30
    inner = gzip.compress(b">x\nAC\n")
    data = text(9, 40) + fake + inner[:-4] + b"\n>z\nAA\n"
    store = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = store.compress(data) + store.flush()
    path = tmp_path / "f.fa.gz"
    path.write_bytes(stored + gzip.compress(b"\n>last\nMK\n"))
    with ranges.open_file(f"file://{path}") as f:
        assert ranges.first_member(f, 1, len(stored) - 5) is None
        assert ranges.first_member(f, 1, path.stat().st_size) == len(stored)


@pytest.mark.parametrize("mode", ["plain", "members", "prefix"])
def test_every_cut_gives_every_record_once(tmp_path, mode, monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK", 64)
    data = b">a\nAC\n\n>b\n>c\nGG>x\n>d\n" + text(5, 30)
    stored = {"plain": data, "members": b"".join(block(data[i:i + 50]) for i in range(0, len(data), 50)), "prefix": gzip.compress(data)}[mode]
    path = tmp_path / "f"
    path.write_bytes(stored)
    expected = [r if i else b">" + r for i, r in enumerate(data[1:].split(b"\n>"))]
    for size in (64, 192, 1024, 64 * 99):
        found = []
        for lo in range(0, len(stored), size):
            found += [r for r, _ in ranges.cut_records(ranges._owned(str(path), mode, lo, min(len(stored), lo + size)), lo == 0)]
        assert found == expected


def test_stream_goes_on_inside_a_file(spark, tree, tmp_path):
    """Two runs of few steps each, then the rest: nothing lost, nothing twice."""
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    modes = {p.rsplit("/", 1)[1]: file_mode(p) for p in glob.glob(tree[7:] + "*.f*")}
    assert modes["a.fa.gz"] == "members" and modes["c.fa.gz"] == "prefix" and modes["d.fasta"] == "plain"
    whole = rows(fasta.scan_fasta_tree(spark, tree, fasta.FASTA_NAME_REGEX, class_from_folder=False))

    def start():
        stream = fasta_range_stream(spark, tree, f"file://{tmp_path}/steps.json", 1, 2)
        return stream.select(*KEY).writeStream.format("parquet").option("checkpointLocation", check) \
            .trigger(processingTime="0 seconds").start(out)

    import time
    for wanted in (1, 2):
        q = start()
        until = time.time() + 60
        while time.time() < until and (q.lastProgress is None or q.lastProgress["batchId"] < wanted - 1):
            time.sleep(0.05)
        q.stop()
        seen = rows(spark.read.parquet(out))
        assert 0 < len(seen) <= len(whole)
    q = start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.read.parquet(out)) == whole


def test_block_files_round_trip(spark, tmp_path):
    from residuum.sinks.writers import write_block_fasta
    df = spark.createDataFrame([(f"r{i} x", "ACDEFGHIKL" * (i % 50)) for i in range(500)], "description string, seq string")
    path = f"file://{tmp_path}/blocks"
    assert write_block_fasta(df.repartition(3), path, 1000) == 500
    back = fasta.scan_fasta_tree(spark, path, class_from_folder=False, range_bytes=2000)
    assert sorted((r.description, r.seq) for r in back.collect()) == sorted((r.description, r.seq) for r in df.collect())
