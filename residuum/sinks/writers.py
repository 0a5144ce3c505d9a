"""Sinks: TSV, FASTA trees, training tables, embedding stores, hits, metrics.

All writes are Spark writes (one file per task and partition value, no
driver-side collection).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.sources.fasta import wrapped_fasta


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: headed, tab-separated; no index column."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_files(spark: SparkSession, root: str) -> list[str]:
    """Data files under ``root`` (recursive listing of metadata only)."""
    fs, p, _ = _fs(spark, root)
    it = fs.listFiles(p, True)
    out = []
    while it.hasNext():
        s = it.next().getPath()
        name = s.getName()
        if not name.startswith(("_", ".")):
            out.append(s.toString())
    return sorted(out)


def rename_extension(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Give Spark's part files a format extension (``.txt`` -> ``.fasta``)."""
    fs, _, jvm = _fs(spark, root)
    for f in list_files(spark, root):
        if f.endswith(old):
            fs.rename(jvm.org.apache.hadoop.fs.Path(f),
                      jvm.org.apache.hadoop.fs.Path(f[: -len(old)] + new))


def write_fasta(df: DataFrame, path: str, partition_cols: Sequence[str] = ("class", "split"),
                width: int = 60, compression: str | None = None,
                header_col: str = "description", seq_col: str = "seq",
                plain_names: bool = False) -> None:
    """SNK2: records as FASTA (``width`` residues per line) into one
    ``column=value`` folder per partition value, in Spark's part files.

    ``plain_names`` is for small exports to other tools: files then end in
    ``.fasta`` (``.fasta.gz``) in folders named by the value alone.  The
    driver renames every file for it, which object stores do by copying.
    """
    cols = list(partition_cols)
    text = wrapped_fasta(F.col(header_col), F.col(seq_col), width).alias("value")
    w = df.select(*cols, text).write.mode("overwrite")
    if cols:
        w = w.partitionBy(*cols)
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    if not plain_names:
        return
    spark = df.sparkSession
    ext = ".txt.gz" if compression == "gzip" else ".txt"
    new = ".fasta.gz" if compression == "gzip" else ".fasta"
    rename_extension(spark, path, ext, new)
    if cols:
        _plain_folders(spark, path)


def _plain_folders(spark: SparkSession, root: str) -> None:
    """Rename ``key=value`` folders to ``value`` (deepest first)."""
    fs, p, jvm = _fs(spark, root)

    def walk(d, depth):
        for st in fs.listStatus(d):
            if st.isDirectory():
                walk(st.getPath(), depth + 1)
                name = st.getPath().getName()
                if "=" in name:
                    fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(
                        st.getPath().getParent(), name.split("=", 1)[1]))
    walk(p, 0)


def write_training_table(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """SNK3: one Parquet table ``seq, label`` partitioned by split (pairs
    cannot drift apart), and its count check per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy(split_col).agg(
        F.count("seq").alias("n_seq"), F.count("labels").alias("n_label"),
        F.sum(F.when(F.length("seq") != F.size("labels"), 1).otherwise(0)).cast("long")
        .alias("n_misaligned"))


def write_embeddings(df: DataFrame, path: str, partition_cols: Sequence[str] = ("model", "split"),
                     mode: str = "overwrite") -> None:
    """SNK4: embedding store, Parquet partitioned by model and split (and by
    ``layer``, if the caller lists it: a store of several layers)."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def _block_files(root: str, block_bytes: int):
    def fn(batches):
        import gzip

        import pyarrow as pa
        from pyspark import TaskContext

        from residuum.sources.ranges import file_system
        context = TaskContext.get()
        fs, folder = file_system(root)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}.fasta.gz"
        attempt, rows, block, size = f"{folder}/_attempt-{context.taskAttemptId()}", 0, [], 0
        with fs.open_output_stream(attempt, compression=None) as out:
            for b in batches:
                for text in b.column("value").to_pylist():
                    data = text.encode() + b"\n"
                    rows += 1
                    for at in range(0, len(data), block_bytes):  # blocks end anywhere, as others' do
                        block.append(data[at:at + block_bytes])
                        size += len(block[-1])
                        if size >= block_bytes:
                            out.write(gzip.compress(b"".join(block), mtime=0))
                            block, size = [], 0
            if block:
                out.write(gzip.compress(b"".join(block), mtime=0))
        if rows:
            fs.move(attempt, name)
        else:
            fs.delete_file(attempt)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "n"])
    return fn


def write_block_fasta(df: DataFrame, path: str, block_bytes: int = 1 << 16) -> int:
    """SNK2 in block-compressed form: a file for each partition, of gzip members of about
    ``block_bytes`` of text, so that readers can split it.  A task that runs again replaces
    its file.  Returns the number of records."""
    text = df.select(wrapped_fasta(F.col("description"), F.col("seq")).alias("value"))
    return text.mapInArrow(_block_files(path, block_bytes), "file string, n long").agg(F.sum("n")).first()[0] or 0


HIT_SALTS = 16


def write_hits(df: DataFrame, path: str, file_col: str = "source_file", salts: int = HIT_SALTS) -> None:
    """SNK5: hits as Parquet, a partition per input file.  A rerun replaces the
    partitions of the files it read and leaves the others.  Rows are clustered
    by file, each file over ``salts`` tasks, so a task writes few files and a
    large input is not one task's."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(tasks, F.col(file_col), salt).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(file_col).parquet(path))


def append_run_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """SNK6: the metric rows of a run (with model name, batch size, epochs) join the
    table of runs at ``path``, a partition a run.  A rerun under the same ``run_id``
    replaces its rows; other runs stay."""
    (metrics.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))
