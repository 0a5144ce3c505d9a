"""Conversation prefix trie by whole-sequence collapse.

Conversations that share their first turns are nodes of a trie; what a server saves by
keeping a shared prefix is the words of its turns, once for each further member.

1. Turns become narrow rows (conversation, depth, four 32-bit words of a hash of depth,
   role and text, word count): no text moves, and the key of a whole sequence, and of
   each prefix, is its depth with the four sums of these words (at least 128 bits). Sums
   need no order and have partial aggregates.
2. Identical conversations are grouped into one weighted sequence, with the list of the
   conversations that end there (in blocks of ids). Only the smallest conversation of
   each goes on: copies, however many, are one sequence from here.
3. Prefix keys are running sums over depth, by group and block of depths. Sequences
   whose key is also a proper prefix go by an anti-join; what is left are the leaves.
4. Weighted prefixes are aggregated to nodes. A sum over a subtree needs no pairs of
   ancestors: each node's value stands once, at its depth in the sequence of its smallest
   member, so running sums from the end of each sequence, aggregated by prefix, are the
   sums over subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.running import running_sums
from residuum.operators.ranking import row_index
from residuum.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20    # conversations of one block of ids start with turns of the first of it
HEADS = 4      # by 0 to 3 of them
ID_BITS = 16   # ids in one row of an end list: 2 ** 16 at most
KEY = ("depth", "s1", "s2", "s3", "s4")
PARENT = ("p0", "p1", "p2", "p3", "p4")
LOW = (1 << 32) - 1


def turn_digest(role: Column, text: Column) -> Column:
    """One digest for role and text (neither null)."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def words32(*columns: Column) -> list[Column]:
    """Four 32-bit words of two hashes, as non-negative longs."""
    out = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *columns)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW))]
    return [w.alias(f"s{k + 1}") for k, w in enumerate(out)]


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, digest, n_words)``, one row a turn of each rebuilt conversation
    and one of depth 0 (no digest, no words) for each conversation.

    Turns are in order of ``turn`` (null first); equal ones by role, then by digest.
    Null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    bucket = F.coalesce(F.shiftright("turn", 16), F.lit(-(1 << 48)))
    own = row_index(own, "conv_id", [F.col("turn").asc_nulls_first(), "role", "digest"], bucket, "i") \
        .select("conv_id", F.col("i").cast("long").alias("i"), "digest", "n_words")
    path = scratch_path(conversations.sparkSession, "trie-turns")
    own.write.parquet(path)
    own = conversations.sparkSession.read.parquet(path)

    first = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEADS - 1)).groupBy(F.col("conv_id").alias("base")) \
        .agg(F.array_sort(F.collect_list(F.struct("i", "digest", "n_words"))).alias("turns"))  # three at most
    convs = own.filter("i = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
                                       heads(F.col("conv_id")).alias("h")).join(first, "base", "left") \
        .select("conv_id", "h", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("h")).alias("turns"))
    shared = convs.select("conv_id", F.explode("turns").alias("t")) \
        .select("conv_id", (F.col("t.i") + 1).alias("depth"), "t.digest", "t.n_words")
    # conversations whose base has fewer turns than asked for move up by the difference
    short = convs.filter(F.size("turns") < F.col("h")).select("conv_id", (F.col("h") - F.size("turns")).alias("up"))
    rest = own.filter(F.col("i") >= heads(F.col("conv_id"))).join(short, "conv_id", "left") \
        .select("conv_id", (F.col("i") + 1 - F.coalesce("up", F.lit(0))).alias("depth"), "digest", "n_words")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"),
                         F.lit(0).cast("long").alias("n_words"))
    return roots.unionByName(shared).unionByName(rest)


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's blocks of ids, joined by commas; rows come sorted by key and
    block, so a key's list is never held."""
    def row(key, sha):
        return [*key, sha.hexdigest()]

    open_key, sha, done = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "ids")]
        for *key, ids in zip(*columns):
            if key != open_key:
                if sha is not None:
                    done.append(row(open_key, sha))
                open_key, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield _rows(done)
            done = []
    if sha is not None:
        yield _rows([row(open_key, sha)])


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())],
                                      names=[*KEY, "ends_sha256"])


def end_lists(whole: DataFrame) -> DataFrame:
    """``KEY`` and the digest of the ids of the conversations that end there. A row
    carries the ids of one block (``ID_BITS``); a sequence's blocks are hashed in order
    as they come, since a digest of a list is serial whatever its length."""
    blocks = whole.groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("block")) \
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block") \
        .mapInArrow(_digest_lists, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: ``conv_id``, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. Extra columns are ignored; an empty table has no node, not even a
    root. Repeated rows are repeated turns."""
    spark = conversations.sparkSession
    turns = rebuilt_turns(conversations)
    none = [F.lit(0).cast("long").alias(f"s{k}") for k in range(1, 5)]
    hashed = turns.filter("depth > 0").select("conv_id", "depth", "n_words", *words32(F.col("depth"), F.col("digest")))
    path = scratch_path(spark, "trie-rows")
    turns.filter("depth = 0").select("conv_id", "depth", "n_words", *none).unionByName(hashed).write.parquet(path)
    rows = spark.read.parquet(path)

    # whole sequences: weight, smallest conversation, end list
    whole = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), *[F.sum(s).alias(s) for s in KEY[1:]])
    path = scratch_path(spark, "trie-whole")
    whole.write.parquet(path)
    whole = spark.read.parquet(path)
    sequences = whole.groupBy(*KEY).agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight"))

    # prefixes of distinct sequences, with the hash of the last turn kept to name the parent
    chosen = sequences.select("seq", "weight", F.col("depth").alias("len"))
    kept = rows.join(chosen, rows["conv_id"] == chosen["seq"]) \
        .select("seq", "weight", "len", "depth", "n_words", *KEY[1:], *[F.col(s).alias(f"a{s[1:]}") for s in KEY[1:]])
    path = scratch_path(spark, "trie-prefixes")
    running_sums(kept, "seq", "depth", KEY[1:]).write.parquet(path)
    prefixes = spark.read.parquet(path)

    proper = prefixes.filter("depth < len").select(*KEY).distinct()
    leaves = sequences.join(proper, list(KEY), "left_anti").select(*KEY, F.lit(1).cast("long").alias("leaf"))

    def nodes(p: DataFrame, *more: Column) -> DataFrame:
        parent = [(F.col("depth") - 1).alias("p0"), *[F.max(F.col(f"s{k}") - F.col(f"a{k}")).alias(f"p{k}") for k in range(1, 5)]]
        return p.groupBy(*KEY).agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"),
                                   F.max("n_words").alias("n_words"), *parent[1:], *more).withColumn("p0", parent[0])

    own = nodes(prefixes).join(leaves, list(KEY), "left") \
        .select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"),
                ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaves"))
    valued = prefixes.join(own, (F.col("seq") == F.col("owner")) & (F.col("depth") == F.col("at")), "left") \
        .select(*prefixes.columns, (F.col("len") - F.col("depth")).alias("to_end"),
                *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("saved", "leaves")])
    path = scratch_path(spark, "trie-nodes")
    nodes(running_sums(valued, "seq", "to_end", ("saved", "leaves")),
          F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")).write.parquet(path)
    table = spark.read.parquet(path)

    children = table.filter("p0 >= 0").groupBy(*PARENT).agg(F.count("*").alias("n_children")) \
        .select(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY)], "n_children")
    full = table.join(children, list(KEY), "left").join(end_lists(whole), list(KEY), "left")
    parents = table.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(k).alias(f"of_{k}") for k in KEY])
    match = [F.col(p) == F.col(f"of_{k}") for p, k in zip(PARENT, KEY)]
    # last, so that a parent of very many children is one that AQE may split
    return full.join(parents, match, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
