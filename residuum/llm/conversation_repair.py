"""Conversation structure repair: cheapest edits that make role sequences well-formed.

1. A row becomes one code letter, its role's initial and its first fault. Equal rows of
   a turn are counted before anything moves; only digests of texts do.
2. Letters are put together by conversation and block of positions. A conversation of
   one block (nearly all) is parsed at once; longer ones are parsed by block, and the
   blocks' cells joined by 256 and then by conversation (see ``repair_grammar``).
3. The audits meet the rows in one shuffle of the texts, sorted by conversation, and
   each row is edited and hashed as it streams by, so a conversation is never held.

The largest things in one place are a conversation's audit (one letter a row; the join
of its last spans has eleven of them) and a batch of rows. A digest of a text is serial,
so the last pass over a very long conversation is one task of constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm import repair_grammar as grammar
from residuum.llm.prefix_trie import turn_digest
from residuum.operators.ranking import row_index
from residuum.session import scratch_path

BLOCK_BITS = 12   # distinct rows in a block: 4096
JOIN_BITS = 8     # blocks joined in one task
SPACES = r"\x20\x09-\x0D"
ORDER = ("turn", "role", "digest")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: rows after the damage, ``n`` copies of each (0:
    dropped). Null role or text is one space, as is a null number in the damage's key."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    named = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    out = left.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_k_{k}" for k in keys])


def coded(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn: ``(conv_id, turn, role, digest, n, first, fault)`` and
    ``letters``, the codes of the ``n`` copies; ``first`` is true for the earliest turn of
    this role and text in the conversation."""
    text = F.col("text")
    faults = rows.select(
        "conv_id", "turn", "role", "n", turn_digest(F.col("role"), text).alias("digest"),
        F.when(~text.rlike(f"[^{SPACES}]"), grammar.BLANK)
        .when(~text.rlike(rf"[.!?][{SPACES}]*\z"), grammar.TRUNCATED).otherwise(grammar.FINE).alias("fault"))
    faults = faults.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.min("fault").alias("fault"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    earliest = faults.filter("n > 0").groupBy("conv_id", "digest").agg(F.min(place).alias("earliest"))
    out = _null_safe(faults, earliest, ("conv_id", "digest"), "left") \
        .withColumn("first", F.coalesce(place == F.col("earliest"), F.lit(False))).drop("earliest")
    initial = F.position(F.substring("role", 1, 1), F.lit(grammar.INITIALS))
    initial = F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)

    def letter(fault):
        return F.substring(F.lit(grammar.CODES), initial * 4 + fault + 1, F.lit(1))

    copies = F.col("n").cast("int")
    again = letter(F.lit(grammar.DUPLICATE))
    return out.withColumn("letters", F.when(F.col("n") == 0, "")
                          .when(F.col("fault") == grammar.BLANK, F.repeat(letter(F.lit(grammar.BLANK)), copies))
                          .when(F.col("first"), F.concat(letter(F.col("fault")), F.repeat(again, copies - 1)))
                          .otherwise(F.repeat(again, copies)))


def counts(codes: DataFrame) -> DataFrame:
    """Gaps and faults of every conversation, of those without rows too."""
    here, seen = F.col("n") > 0, F.col("fault") != grammar.BLANK

    def total(when, value):
        return F.coalesce(F.sum(F.when(here & when, value)), F.lit(0)).cast("long")

    turn = F.when(here, F.col("turn"))
    wide = [f(turn).cast("decimal(38,0)") for f in (F.max, F.min)]
    return codes.groupBy("conv_id").agg(
        F.coalesce((wide[0] - wide[1] + 1 - F.count_distinct(turn)).try_cast("bigint"), F.lit(0)).cast("long").alias("gaps"),
        total(~seen, F.col("n")).alias("blank"),
        total(seen, F.when(F.col("first"), F.col("n") - 1).otherwise(F.col("n"))).alias("duplicate"),
        total(F.col("first") & (F.col("fault") == grammar.TRUNCATED), F.lit(1)).alias("truncated"))


PARSED = "conv_id long, illegal long, cost long, audit string"
SPAN = "conv_id long, span long, head string, tail string, illegal long, costs array<long>, audits array<string>"


def _parse_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("letters").to_pylist()
        best = [grammar.cheapest(grammar.parse_codes(c)) for c in codes]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id").cast(pa.int64()), pa.array([grammar.illegal(c) for c in codes], pa.int64()),
             pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
            names=["conv_id", "illegal", "cost", "audit"])


def _span_rows(conv_ids, spans, heads, tails, illegal, cells) -> pa.Table:
    return pa.table({
        "conv_id": pa.array(conv_ids, pa.int64()), "span": pa.array(spans, pa.int64()), "head": pa.array(heads, pa.string()),
        "tail": pa.array(tails, pa.string()), "illegal": pa.array(illegal, pa.int64()),
        "costs": pa.array([[None if x is None else x[0] for x in c] for c in cells], pa.list_(pa.int64())),
        "audits": pa.array([[None if x is None else x[1] for x in c] for c in cells], pa.list_(pa.string()))})


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("letters").to_pylist()
        yield from _span_rows(batch.column("conv_id").to_pylist(), batch.column("span").to_pylist(),
                              [c[0] for c in codes], [c[-1] for c in codes], [grammar.illegal(c) for c in codes],
                              [grammar.parse_codes(c) for c in codes]).to_batches()


def _join_spans(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["span"])
    cells = [tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])) for r in rows]
    between = sum(grammar.illegal(a["tail"] + b["head"]) for a, b in zip(rows, rows[1:]))
    return _span_rows([rows[0]["conv_id"]], [rows[0]["span"] >> JOIN_BITS], [rows[0]["head"]], [rows[-1]["tail"]],
                      [between + sum(r["illegal"] for r in rows)], [grammar.parse(cells)])


def _best_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [grammar.cheapest([None if c is None else (c, a) for c, a in zip(cs, xs)])
                for cs, xs in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("illegal"), pa.array([b[0] for b in best], pa.int64()),
             pa.array([b[1] for b in best], pa.string())], names=["conv_id", "illegal", "cost", "audit"])


def parsed(codes: DataFrame) -> DataFrame:
    """``conv_id``, ``illegal``, ``cost`` and ``audit`` of every conversation with rows."""
    spark = codes.sparkSession
    bucket = F.coalesce(F.shiftright("turn", 16), F.lit(-(1 << 48)))
    order = [F.col("turn").asc_nulls_first(), *ORDER[1:]]
    placed = row_index(codes.filter("n > 0").select("conv_id", *ORDER, "letters"), "conv_id", order, bucket, "i")
    pieces = F.array_sort(F.collect_list(F.struct("i", "letters")))
    path = scratch_path(spark, "repair-blocks")
    placed.groupBy("conv_id", F.shiftright(F.col("i").cast("long"), BLOCK_BITS).alias("span")) \
        .agg(F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("letters")).write.parquet(path)
    blocks = spark.read.parquet(path)
    long = blocks.filter("span > 0").select("conv_id").distinct()
    whole = _null_safe(blocks, long, ("conv_id",), "left_anti").mapInArrow(_parse_whole, PARSED)
    spans = _null_safe(blocks, long, ("conv_id",), "left_semi").mapInArrow(_parse_blocks, SPAN)
    for by in (F.shiftright("span", JOIN_BITS), F.lit(0).cast("long")):
        spans = spans.groupBy("conv_id", by.alias("of")).applyInArrow(_join_spans, SPAN)
    return whole.unionByName(spans.mapInArrow(_best_spans, PARSED))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's facts (first in its run of rows) with the digest of its rows
    after the edits."""
    facts = replay = sha = None
    started, done = False, []

    def put(line: str) -> None:
        nonlocal started
        sha.update(("\n" if started else "").encode() + line.encode())
        started = True

    def close() -> None:
        if facts is not None:
            for line in replay.inserted():
                put(line)
            done.append((*facts, sha.hexdigest()))

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.string()) for c in columns[-2:]],
            names=["conv_id", *FACTS, "audit", "repaired_sha256"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *FACTS, "role", "text", "n")]
        for conv_id, *values, role, text, n in zip(*columns):
            if n is None:  # a conversation begins
                close()
                facts, replay, sha, started = (conv_id, *values, text), grammar.Replay(text), hashlib.sha256(), False
                continue
            for _ in range(n):
                for line in replay.inserted():
                    put(line)
                line = replay.row(role, text)
                if line is not None:
                    put(line)
        if done:
            yield out()
    close()
    if done:
        yield out()


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256`` of every conversation of ``conversations``, after the
    damage of ``damaged``.

    Rows of one turn are in order of role, then of the digest of role and text. Rows of a
    null conv_id are one conversation. Extra columns are ignored; an empty table gives no
    row; gaps beyond a long are 0."""
    spark = conversations.sparkSession
    rows = damaged(conversations)
    path = scratch_path(spark, "repair-codes")
    coded(rows).write.parquet(path)
    codes = spark.read.parquet(path)
    facts = _null_safe(counts(codes), parsed(codes), ("conv_id",), "left") \
        .select("conv_id", *FACTS[:4], *[F.coalesce(c, F.lit(0)).alias(c) for c in FACTS[4:]],
                F.coalesce("audit", F.lit("")).alias("text"))
    stream = facts.unionByName(rows.filter("n > 0"), allowMissingColumns=True) \
        .repartition("conv_id") \
        .withColumn("digest", F.when(F.col("n").isNotNull(), turn_digest(F.col("role"), F.col("text")))) \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("n").isNotNull(), F.col("turn").asc_nulls_first(), *ORDER[1:])
    return stream.drop("digest", "turn").mapInArrow(
        _edit, "conv_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string")
