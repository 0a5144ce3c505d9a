"""SentencePiece encoding and decoding as a relational lattice.

A text is turned into units that no piece can span: a cut comes before a run of word
marks, around characters that no piece of two or more characters holds, and before
punctuation that no piece joins to a letter. So units are encoded on their own, each
distinct one once:

* every substring of a unit up to the longest piece is exploded and equi-joined to
  the (broadcast) piece table; the matches are the edges of the unit's lattice;
* edges are grouped by unit;
* a higher-order ``aggregate`` folds the lattice into the best path. For a unigram
  model that is Viterbi: the path of highest score. A BPE model's scores are merge
  priorities, whose best path is not the highest sum; there the fold applies the
  merges: while two neighbouring spans join into an edge, the edge of best score
  (leftmost on ties) replaces them.

Characters without a piece become byte pieces (the model must have all 256).

Documents are dealt to blocks of about ``BLOCK_BYTES`` of text, packed and compressed
for the shuffle. A block sends its distinct units to the lattice and gets their ids
back, so what moves is bounded by the units of a block, not by their occurrences; a
frequent unit is one row for each block. A unit of more than ``MASK_CHARS``
characters, which the fold's bit mask does not hold, is folded by the same rule in
the function that puts a block's documents together.

Null text gives null ids; an empty text has none. Repeated rows and null ids of
documents are kept as they are; other columns are not read unless asked for.
"""

from __future__ import annotations

import heapq
import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.common import give_back

MARK = "▁"             # stands for a space
BLOCK_BYTES = 32 << 20
PART_BYTES = 1 << 20   # of text that is packed together
LATTICE_TASKS = 5      # for each block, so that a task gathers the edges of few units
MASK_CHARS = 60
UNIGRAM, BPE = 1, 2         # fixed values of the model file: model types
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # and piece types


def _fields(data: bytes):
    """``(field, value)`` of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces of a model; ``pieces[i]`` is ``(text, score, type)`` of id i."""
    pieces: list[tuple[str, float, int]]
    kind: int
    prefix: bool = True

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, prefix = [], UNIGRAM, True
        for key, value in _fields(data):
            if key == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif key == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif key == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(1, b"identity") != b"identity" or spec.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep white space")
        return cls(pieces, kind, prefix)

    def __post_init__(self):
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        if any(t == USER_DEFINED for _, _, t in self.pieces):
            raise ValueError("only models without user-defined pieces")
        self.usable = {p: (i, s) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL and p}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with all byte pieces")
        self.longest = max(map(len, self.usable))
        self.worst = min(s for _, s in self.usable.values()) - 10.0  # of a character without a piece

    def fold(self, unit: str) -> list[int]:
        """Ids of one unit, for units too long for the mask."""
        return merge(unit, self.usable, self.bytes) if self.kind == BPE else \
            best_path(unit, self.usable, self.bytes, self.longest, self.worst)

    def cuts(self) -> list[tuple[str, str | None]]:
        """Pairs of patterns between which no piece can span; with None for the
        second, a character around which none can."""
        long = [p for p in self.usable if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):  # a piece goes on after a mark: no cut is safe
            return []
        inside = {c for p in long for c in p}
        solo = "".join(rf"\x{{{c:X}}}" for c in range(128) if chr(c) not in inside)
        joined = {b for p in long for a, b in zip(p, p[1:]) if a.isalpha()}
        enders = "".join(rf"\x{{{c:X}}}" for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in joined)
        out = [("", MARK)]
        if enders:
            out.append((r"\p{L}", f"[{enders}]"))
        return out + ([(f"[{solo}]", None)] if solo else [])

    def marked(self, text: str) -> str:
        return ((" " if self.prefix else "") + text).replace(" ", MARK) if text else ""


def merge(unit: str, vocab: dict[str, tuple[int, float]], byte_ids: dict[int, int]) -> list[int]:
    """Ids of a unit by the merges of a BPE model (for units too long for the mask)."""
    n = len(unit)
    ends, starts = list(range(1, n + 1)), list(range(-1, n - 1))  # next and previous span's start
    heap: list[tuple] = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < n:
            found = vocab.get(unit[a:ends[b]])
            if found:
                heapq.heappush(heap, (-found[1], a, b, ends[b]))

    for a in range(n - 1):
        offer(a)
    alive = [True] * n
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not (alive[a] and ends[a] == b and b < n and alive[b] and ends[b] == c):
            continue
        alive[b] = False
        ends[a] = c
        if c < n:
            starts[c] = a
        offer(a)
        if starts[a] >= 0:
            offer(starts[a])
    out, a = [], 0
    while a < n:
        found = vocab.get(unit[a:ends[a]])
        out += [found[0]] if found else [byte_ids[x] for x in unit[a:ends[a]].encode()]
        a = ends[a]
    return out


def best_path(unit: str, vocab: dict[str, tuple[int, float]], byte_ids: dict[int, int], longest: int,
              worst: float) -> list[int]:
    """Ids of a unit by the highest score (unigram; for units too long for the mask)."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - longest), j):
            found = vocab.get(unit[i:j])
            score = best[i][0] + (found[1] if found else worst if j == i + 1 else -math.inf)
            if score > best[j][0]:
                best[j] = (score, i)
    out: list[list[int]] = []
    j = len(unit)
    while j:
        i = best[j][1]
        found = vocab.get(unit[i:j])
        out.append([found[0]] if found else [byte_ids[x] for x in unit[i:j].encode()])
        j = i
    return [x for part in reversed(out) for x in part]


# Characters below this code point are looked up in an array; those beyond are
# joined to the piece table like longer substrings.
LOOKED_UP = 0x2600


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def lattice(units: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The columns of ``units`` (``unit``, distinct, of 1 to ``MASK_CHARS``
    characters), its length ``n`` and its ``edges``, best first.

    An edge from place i to j is ``(key, id, ends, inner, score)``: ``key`` orders by
    score, then i; ``ends`` has the bits of i and j, ``inner`` those between."""
    rank = {score: k for k, score in enumerate(sorted({s for _, s in vocab.usable.values()}, reverse=True))}
    rows = [(p, i, rank[s] * 64, float(s)) for p, (i, s) in vocab.usable.items()
            if len(p) > 1 or ord(p) >= LOOKED_UP] + [("", -1, 0, 0.0)]
    pieces = units.sparkSession.createDataFrame(rows, "piece string, id int, rank bigint, score double")
    others = [c for c in units.columns if c != "unit"]
    # at each place: the substrings of two characters and more, one character only
    # if it is not looked up, and once for each unit the empty one, which keeps a
    # unit of which nothing matches
    lengths = F.expr(f"""concat(if(i = 0, array(0), array()),
        if(ascii(substring(unit, i + 1, 1)) >= {LOOKED_UP}, array(1), array()),
        if(n - i >= 2, sequence(2, least({vocab.longest}, n - i)), array()))""")
    subs = units.withColumn("n", F.length("unit")).withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))) \
        .withColumn("l", F.explode(lengths)).withColumn("piece", F.expr("substring(unit, i + 1, l)"))
    edge = [(F.col("rank") + F.col("i")).alias("key"), F.col("id"),
            F.expr("shiftleft(1L, i) | shiftleft(1L, i + l)").alias("ends"),
            F.expr("(shiftleft(1L, i + l) - 1L) & ~(shiftleft(1L, i + 1) - 1L)").alias("inner")]
    if vocab.kind == UNIGRAM:
        edge.append(F.col("score"))
    edges = subs.join(F.broadcast(pieces), "piece").select(
        *units.columns, "n", F.when(F.col("id") >= 0, F.struct(*edge)).alias("e"))
    return edges.groupBy("unit").agg(*[F.first(c).alias(c) for c in [*others, "n"]],
                                     F.sort_array(F.collect_list("e")).alias("edges"))


def fold_merges(edges: Column, n: Column) -> Column:
    """Bit mask of the cuts that are left when no two neighbouring spans form an edge."""
    def step(cuts, _):
        fits = F.filter(edges, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"])
                        & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1))
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inner"], F.lit(0).cast("bigint"))))

    every = _bit(n + 1) - F.lit(1).cast("bigint")
    return F.when(F.size(edges) == 0, every).otherwise(F.aggregate(F.sequence(F.lit(1), n), every, step))


def fold_viterbi(edges: Column, n: Column, one_score: Column, unit: Column) -> Column:
    """Bit mask of the cuts of the path of highest score. The state holds, for each
    place, the best score and the cuts that lead to it. ``one_score``: array of the
    scores of single characters by code point."""
    start = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        F.when(k == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("score"), F.lit(1).cast("bigint").alias("cuts")))

    def reach(best, j):
        into = F.filter(edges, lambda e: (e["ends"] >= _bit(j)) & (e["ends"] < _bit(j + 1)))
        point = F.ascii(F.substring(unit, j, F.lit(1)))
        single = F.when(point < LOOKED_UP, F.get(one_score, point)).otherwise(F.get(one_score, F.lit(0)))
        before = F.get(best, j - 1)
        paths = F.concat(
            F.transform(into, lambda e: F.struct(
                (F.get(best, (e["key"] % 64).cast("int"))["score"] + e["score"]).alias("score"),
                F.get(best, (e["key"] % 64).cast("int"))["cuts"].bitwiseOR(_bit(j)).alias("cuts"))),
            F.array(F.struct((before["score"] + single).alias("score"), before["cuts"].bitwiseOR(_bit(j)).alias("cuts"))))
        return F.transform(best, lambda b, k: F.when(k == j, F.array_max(paths)).otherwise(b))

    return F.aggregate(F.sequence(F.lit(1), n), start, reach, lambda best: F.get(best, n)["cuts"])


def path_ids(cuts: Column, edges: Column, n: Column, unit: Column, one_id: Column, first_byte: Column) -> Column:
    """Ids of the spans between cuts, in order; a character without a piece gives
    its bytes. Ids are sorted as ``(4 * place + byte) << 32 | id``."""
    def at(place, i):
        return F.call_function("shiftleft", place.cast("bigint"), F.lit(32)).bitwiseOR(i.cast("bigint"))

    def char(i):
        return F.substring(unit, i + 1, F.lit(1))

    spans = F.filter(edges, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (cuts.bitwiseAND(e["inner"]) == 0))
    known = F.transform(spans, lambda e: at(e["key"] % 64 * 4, e["id"]))
    three = F.lit(3).cast("bigint")
    alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftright", cuts, i).bitwiseAND(three) == three)
    joined = F.transform(F.filter(spans, lambda e: e["inner"] == 0), lambda e: (e["key"] % 64).cast("int"))
    alone = F.when(F.size(joined) > 0, F.array_except(alone, joined)).otherwise(alone)
    single = F.transform(alone, lambda i: at(i * 4, F.coalesce(F.get(one_id, F.ascii(char(i))), F.lit(-1))))
    bare = F.filter(alone, lambda i: F.coalesce(F.get(one_id, F.ascii(char(i))), F.lit(-1)) < 0)
    raw = F.flatten(F.transform(bare, lambda i: F.transform(
        F.sequence(F.lit(0), F.octet_length(char(i)) - 1), lambda k: at(i * 4 + k, F.get(
            first_byte, F.conv(F.substring(F.hex(char(i)), k * 2 + 1, F.lit(2)), 16, 10).cast("int"))))))
    some_bare = F.exists(single, lambda x: x < 0)
    every = F.when(some_bare, F.concat(known, F.filter(single, lambda x: x >= 0), raw)).otherwise(F.concat(known, single))
    return F.transform(F.sort_array(every), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int"))


def encode_units(units: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The columns of ``units`` (``unit``, distinct, of 1 to ``MASK_CHARS`` characters)
    and its ``ids``. Keeps a partitioning by unit."""
    edges, n, unit = F.col("edges"), F.col("n"), F.col("unit")
    chars = [vocab.usable.get(chr(c), (-1, vocab.worst)) for c in range(LOOKED_UP)]
    one_id = F.split(F.lit(",".join(str(i) for i, _ in chars)), ",").cast("array<int>")
    byte_ids = F.array(*[F.lit(vocab.bytes[b]) for b in range(256)])
    if vocab.kind == BPE:
        cuts = fold_merges(edges, n)
    else:  # code point 0 stands for characters that are not looked up
        one_score = F.split(F.lit(",".join(repr(s) for _, s in [(0, vocab.worst), *chars[1:]])), ",").cast("array<double>")
        cuts = fold_viterbi(edges, n, one_score, unit)
    return lattice(units, vocab).withColumn("cuts", cuts) \
        .select(*units.columns, path_ids(F.col("cuts"), edges, n, unit, one_id, byte_ids).alias("ids"))


def cut_units(texts: pa.Array, cuts: list[tuple[str, str]], prefix: bool) -> pa.ListArray:
    """Units of each text (null for a null or empty one), spaces as marks."""
    texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts)
    # a character that no text holds marks the cuts (U+FDD0 to U+FDEF are no characters)
    sign = next(c for c in map(chr, range(0xFDD0, 0xFDF0)) if not pc.any(pc.match_substring(texts, c)).as_py())
    at_marks = bool(cuts)
    marked = pc.replace_substring(texts, " ", sign + MARK if at_marks else MARK)
    if prefix:
        marked = pc.binary_join_element_wise(MARK, marked, "")
    for _ in range(2 * at_marks):  # a run of marks stays together: every second cut in it goes at a time
        marked = pc.replace_substring(marked, MARK + sign + MARK, MARK + MARK)
    for before, after in cuts[1:]:
        if after is None:
            marked = pc.replace_substring_regex(marked, f"({before})", rf"{sign}\1{sign}")
        else:
            marked = pc.replace_substring_regex(marked, f"({before})({after})", rf"\1{sign}\2")
    parts = pc.split_pattern(marked, sign)
    flat, size = parts.flatten(), np.asarray(pc.fill_null(parts.value_lengths(), 0))
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.concatenate([[0], totals(some.astype(np.int64), size).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, flat.filter(pa.array(some)))


def decodes_wrong(ids_of: "Ragged", units: pa.Array, table: list[bytes]) -> np.ndarray:
    """1 for each unit whose ids do not decode to it."""
    of_id = Ragged(np.frombuffer(b"".join(table), np.uint8), np.array(list(map(len, table)), np.int64))
    out = np.zeros(len(units), np.int64)
    for lo in range(0, len(units), 100_000):
        part = pc.replace_substring(units.slice(lo, 100_000), MARK, " ").cast(pa.binary())
        ids, n_ids = ids_of.rows(np.arange(lo, lo + len(part)))
        raw, width = of_id.rows(ids)
        width, want = totals(width, n_ids), np.asarray(pc.binary_length(part))
        have = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
        if len(raw) == len(have) and np.array_equal(raw, have) and np.array_equal(width, want):
            continue
        a, b = raw.tobytes(), part.to_pylist()
        ends = np.concatenate([[0], np.cumsum(width)])
        out[lo:lo + len(part)] = [a[x:y] != z for x, y, z in zip(ends[:-1], ends[1:], b)]
    return out


def units_of(blob: pa.BinaryScalar, cuts, prefix: bool) -> pa.ListArray:
    return cut_units(_unpacked(blob).column("text").combine_chunks(), cuts, prefix)


def block_units(parts) -> tuple[pa.Array, pa.Array]:
    """Distinct units of a block, sorted: those that go through the lattice, and the
    longer ones. ``parts``: arrays of units."""
    units = pa.chunked_array(parts, pa.string()).unique()
    units = units.take(pc.sort_indices(units))
    short = pc.less_equal(pc.utf8_length(units), MASK_CHARS)
    return units.filter(short), units.filter(pc.invert(short))


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows ``which``, end to end, and the length of each."""
        length = self.lengths[which]
        before = np.cumsum(length) - length
        return self.values[np.repeat(self.starts[which] - before, length) + np.arange(length.sum())], length


def totals(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes`` values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stop = np.cumsum(sizes)
    return ends[stop] - ends[stop - sizes]


def _unpacked(blob: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def byte_table(vocab: Vocabulary) -> list[bytes]:
    """The bytes that each id stands for."""
    return [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t == NORMAL else b""
            for p, _, t in vocab.pieces]


def text_of(ids, table: list[bytes], prefix: bool) -> str:
    """Text of a sequence of ids: pieces and byte pieces as bytes, marks as spaces."""
    raw = b"".join(map(table.__getitem__, ids))
    return (raw[1:] if prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def block_table(packed: pa.Table, cuts, prefix: bool) -> pa.Table:
    """``place, unit``: the distinct units of a block that go through the lattice."""
    short, _ = block_units([units_of(blob, cuts, prefix).flatten().unique() for blob in packed.column("blob")])
    block = packed.column("block")[0].as_py()
    give_back()
    return pa.table({"place": pa.array(np.arange(len(short), dtype=np.int64) + (block << 32)), "unit": short})


def unit_ids(coded: pa.Table, short: pa.Array, long: pa.Array, vocab: Vocabulary) -> Ragged:
    """Ids of a block's units in their order, the longer ones last."""
    lists = coded.column("ids").combine_chunks().take(
        pa.array(np.argsort(np.asarray(coded.column("nth")), kind="stable")))
    if len(lists) != len(short):
        raise ValueError("a block's units and their ids differ in number")
    folded = [vocab.fold(u) for u in long.to_pylist()]
    return Ragged(
        np.concatenate([np.asarray(lists.flatten(), np.int32), *[np.array(x, np.int32) for x in folded]]),
        np.concatenate([np.asarray(lists.value_lengths(), np.int64), [len(x) for x in folded]]).astype(np.int64))


def assembled(packed: pa.Table, coded: pa.Table, vocab: Vocabulary, cuts, round_trip: bool) -> pa.Table:
    """The documents of a block with their ids."""
    parts, owns = [], []  # of each packed part: units by place in its own list, units of each text; that list
    for blob in packed.column("blob"):
        lists = units_of(blob, cuts, vocab.prefix)
        codes = lists.flatten().dictionary_encode()
        small = np.uint16 if len(codes.dictionary) <= 1 << 16 else np.int32
        parts.append((np.asarray(codes.indices).astype(small), np.asarray(lists.value_lengths())))
        owns.append(codes.dictionary)
        del lists, codes
    short, long = block_units(owns)
    ids_of = unit_ids(coded, short, long, vocab)
    every = pa.concat_arrays([short, long])
    wrong = decodes_wrong(ids_of, every, byte_table(vocab)) if round_trip else None
    # places of all parts' own units in the block's list, looked up at once
    places = np.asarray(pc.index_in(pa.concat_arrays(owns), value_set=every))
    starts = np.cumsum([0] + [len(own) for own in owns])
    del short, long, every, owns
    give_back()
    out = []
    parts.reverse()
    for blob, lo, hi in zip(packed.column("blob"), starts, starts[1:]):
        codes, size = parts.pop()  # gone when its documents are done
        done = _unpacked(blob)
        units = places[lo:hi][codes]
        ids, length = ids_of.rows(units)
        ends = np.concatenate([[0], np.cumsum(totals(length, size))]).astype(np.int32)
        missing = done.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        offsets = pa.array(ends, mask=np.append(missing, False))
        done = done.drop_columns("text").append_column("ids", pa.ListArray.from_arrays(offsets, pa.array(ids)))
        if round_trip:  # a text is its units end to end
            done = done.append_column("round_trip", pa.array(totals(wrong[units], size) == 0))
        out.append(done)
    give_back()
    return pa.concat_tables(out)


def encode(docs: DataFrame, vocab: Vocabulary, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
           round_trip: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` for each row of ``docs``; with ``round_trip`` also
    whether the ids decode to the text (a mark in a text decodes to a space)."""
    src = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in keep])
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    cuts, shared = vocab.cuts(), docs.sparkSession.sparkContext.broadcast(vocab)

    def pack(batches):
        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))
        for b in batches:
            where = b.column(0).to_numpy()
            part = pa.RecordBatch.from_arrays(b.columns[1:], names=b.schema.names[1:])
            order = np.argsort(where, kind="stable")
            # runs of one block, and in them of about PART_BYTES, as each part is cut at once
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0).take(pa.array(order))))
            cut = (np.diff(where[order], prepend=-1) != 0) | (np.diff(size // PART_BYTES, prepend=-1) != 0)
            out_block, out_blob = [], []
            for rows in np.split(order, np.flatnonzero(cut)[1:]) if len(order) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=how) as w:
                    w.write_batch(part.take(pa.array(rows)))
                out_block.append(int(where[rows[0]]))
                out_blob.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(out_block, pa.int32()), pa.array(out_blob, pa.binary())], ["block", "blob"])

    def distinct(table: pa.Table) -> pa.Table:
        return block_table(table, cuts, shared.value.prefix)

    def assemble(packed: pa.Table, coded: pa.Table) -> pa.Table:
        return assembled(packed, coded, shared.value, cuts, round_trip)

    key = F.pmod(F.xxhash64("text", *[f"k_{c}" for c in keep]), F.lit(blocks)).cast("int").alias("block")
    packed = src.select(key, "*").mapInArrow(pack, "block int, blob binary")
    # both sides of the join read one exchange: it has the same columns and filter
    # for either, as the first place of a unit is part of the join condition
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LATTICE_TASKS * blocks)
    places = packed.groupBy("block").applyInArrow(distinct, "place bigint, unit string") \
        .filter(F.col("place").isNotNull() & F.col("unit").isNotNull()).repartition(tasks, "unit")
    small = "smallint" if len(vocab.pieces) <= 1 << 15 else "int"
    coded = encode_units(places.groupBy("unit").agg(F.min("place").alias("first")), vocab)
    back = places.join(coded.withColumnRenamed("unit", "of"), (F.col("unit") == F.col("of")) & (F.col("first") <= F.col("place"))) \
        .select(F.shiftright("place", 32).cast("int").alias("block"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("nth"),
                F.col("ids").cast(f"array<{small}>").alias("ids"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:]]
    out = packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        assemble, ", ".join([*fields, "ids array<int>", *["round_trip boolean"] * round_trip]))
    return out.select(*[F.col(f"`k_{c}`").alias(c) for c in keep], "ids", *["round_trip"] * round_trip)


def decode(ids: Column, vocab: Vocabulary, spark) -> Column:
    """Text of an array of ids; null for null."""
    shared = spark.sparkContext.broadcast((byte_table(vocab), vocab.prefix))

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        table, prefix = shared.value
        return pa.array([None if row is None else text_of(row, table, prefix) for row in column.to_pylist()], pa.string())

    return text(ids)
