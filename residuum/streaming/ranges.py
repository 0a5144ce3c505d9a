"""A stream of FASTA records whose offset lies inside files.

The file stream of ``stream.py`` commits whole files.  Here the offset is, for each file,
how many of its steps (ranges of stored bytes) are read; a trigger takes at most
``maxSteps`` steps over all files, a task each, and a restart goes on in the middle of a
file.  Plain and block-compressed files are entered at the step.  A gzip file of one
member must be decompressed from its start, so it is read in ``PREFIX_STEPS`` steps at
most, which together decompress it about nine times at worst, however large it is.

Files are taken as complete when they appear.  The offset names every file seen, so this
source is for some thousands of large files; many small ones go to the file stream.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from residuum.sources.fasta import FASTA_NAME_REGEX, parse_records
from residuum.sources.ranges import CHUNK, RAW, file_system, open_file, range_batches

PREFIX_STEPS = 16
STEP_BYTES = 256 << 20


def file_mode(path: str) -> str:
    """``plain``, ``members`` (block-compressed: sizes of blocks in the headers) or ``prefix``."""
    if not path.lower().endswith(".gz"):
        return "plain"
    with open_file(path) as f:
        head = f.read(18)
    return "members" if head[3:4] == b"\x04" and head[12:14] == b"BC" else "prefix"


def step_bytes(mode: str, size: int, asked: int) -> int:
    if mode == "prefix":
        asked = max(asked, -(-size // PREFIX_STEPS))
    return max(CHUNK, -(-asked // CHUNK) * CHUNK)


class Step(InputPartition):
    def __init__(self, path: str, number: int, asked: int):
        self.path, self.number, self.asked = path, number, asked


class RangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        import re
        self.root, self.progress = options["path"], options["progress"]
        self.name = re.compile(options.get("nameregex", FASTA_NAME_REGEX))
        self.asked, self.max_steps = int(options.get("stepbytes", STEP_BYTES)), int(options.get("maxsteps", 8))
        self.at: dict | None = None
        self.modes: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def _committed(self) -> dict:
        fs, path = file_system(self.progress)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_file(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        """What is read after the next trigger: a step more of the files that have one,
        in order of name, round after round, ``maxSteps`` in all."""
        if self.at is None:
            self.at = self._committed()
        fs, inner = file_system(self.root)
        prefix = self.root[:len(self.root) - len(inner)] if self.root.endswith(inner) else "file://"
        found = [f for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True))
                 if f.type == pafs.FileType.File and f.size and self.name.match(f.base_name)]
        to, left = dict(self.at), self.max_steps
        steps = {}
        for f in sorted(found, key=lambda f: f.path):
            path = prefix + f.path
            if path not in self.modes:  # a new file: its header is read once
                self.modes[path] = file_mode(path)
            steps[path] = -(-f.size // step_bytes(self.modes[path], f.size, self.asked))
        while left and (unread := [p for p in steps if to.get(p, 0) < steps[p]]):
            for path in unread[:left]:
                to[path] = to.get(path, 0) + 1
            left -= min(left, len(unread))
        return to

    def partitions(self, start: dict, end: dict) -> list[Step]:
        self.at = {p: max(start.get(p, 0), end.get(p, 0)) for p in {*start, *end}}
        return [Step(p, k, self.asked) for p in sorted(end) for k in range(start.get(p, 0), end[p])]

    def read(self, partition: Step):
        mode = file_mode(partition.path)
        with open_file(partition.path) as f:
            size = f.size()
        step = step_bytes(mode, size, partition.asked)
        lo = partition.number * step
        yield from range_batches(partition.path, mode, lo, min(size, lo + step), partition.number)

    def commit(self, end: dict) -> None:
        """Where the next run's first trigger begins; the query's checkpoint says what was
        delivered, and a step that both name is not read again."""
        fs, path = file_system(self.progress)
        with fs.open_output_stream(path + ".new") as f:
            f.write(json.dumps(end).encode())
        fs.move(path + ".new", path)


class FastaRanges(DataSource):
    """Options: ``path``, ``progress`` (a file beside the checkpoint), ``nameRegex``,
    ``stepBytes``, ``maxSteps``."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return RAW

    def streamReader(self, schema) -> RangeReader:
        return RangeReader({k.lower(): v for k, v in self.options.items()})


def fasta_range_stream(spark: SparkSession, src_dir: str, progress: str, step_size: int = STEP_BYTES,
                       max_steps: int = 8, name_regex: str = FASTA_NAME_REGEX) -> DataFrame:
    """Records of every FASTA file under ``src_dir``, in bounded steps."""
    spark.dataSource.register(FastaRanges)
    raw = spark.readStream.format("fasta_ranges").option("path", src_dir).option("progress", progress) \
        .option("nameRegex", name_regex).option("stepBytes", step_size).option("maxSteps", max_steps).load()
    return parse_records(raw)
