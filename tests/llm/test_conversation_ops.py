"""Prefix trie and structure repair of conversations against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from llm_helpers import SF, query, table_dir

from residuum.llm import repair_grammar as grammar
from residuum.llm.conversation_repair import repair
from residuum.llm.prefix_trie import prefix_trie
from residuum.llm.running import running_sums

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def place(turn, role, text):
    return (turn is not None, turn or 0), role, digest(role, text)


def plain_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((place(turn, role or "", text or ""), role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v, key=lambda r: r[0])] for c, v in conv.items()}
    whole, members, kids = {}, defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, m in members.items():
        subtree, stack = [], [k]
        while stack:
            subtree.append(stack.pop())
            stack += kids[subtree[-1]]
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]),
                    sum(not kids[x] for x in subtree),
                    sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in subtree if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def plain_parse(rows):
    """Cheapest (cost, audit) over (initial, must go, truncated), by a shortest-path search."""
    done, heap = {}, [(0, "", 0, 0)]
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done[i, s] = (cost, audit)
        moves = [(r, q) for (p, r), q in NEXT.items() if p == s]
        for r, q in moves:
            if r != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, q))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s))
            for r, q in [] if must_go else moves:
                if r == initial:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, q))
                if r != "s":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, q))
    return min(done[len(rows), s] for s in (0, 3) if (len(rows), s) in done)


def plain_repair(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if k == 4 else " " if role is None else role), (" " if text is None else text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        conv[c] += [(place(turn, role, text), role, text, turn)] * {0: 0, 3: 2}.get(k, 1)
    out = []
    for c, rs in conv.items():
        rs.sort(key=lambda r: r[0])
        turns = [r[3] for r in rs if r[3] is not None]
        faults, seen = [], set()
        for _, role, text, _ in rs:
            shown = text.strip(" \t\n\v\f\r")
            faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = plain_parse([(r[1][:1], f in ("b", "d"), f == "t") for r, f in zip(rs, faults)])
        lines, state, left = [], 0, iter(rs)
        for edit in audit:
            due = "assistant" if state == 2 else "user"
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role, text = (row[1] if edit == "K" else due), (row[2] if row else "")
            state = NEXT[state, role[:1]]
            lines.append(f"{role}:{text}")
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, "bdt"),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def odd_rows(seed=3):
    """Nulls everywhere, ties, repeated rows, negative ids, long and empty texts, other roles."""
    rng = random.Random(seed)
    roles = [None, "user", "assistant", "system", "", "User", "ux", "tool"]
    texts = [None, "", " \t", "a.", "b", "c!\n", "x. y", "q?", "long " * 40_000 + "."]
    rows = [(rng.choice([None, 0, 1, 2, 3, -5, 20, 39]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts))
            for _ in range(90)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}.") for c in range(400, 420) for t in range(4)]  # copies
    return rows + [(601, 0, "user", "alone.")]  # a base that is absent


def frame(spark, rows, extra=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, TURNS)
    names = ["i", "n", "digest", "depth", "s1", "span", "letters", "fault", "seq", "weight", "ids", "_block", "_bk", "audit"]
    return df.select("*", *[F.lit("x").alias(c) for c in names]) if extra else df


@pytest.mark.parametrize("extra", [False, True])
def test_trie_and_repair_of_odd_rows(spark, extra):
    rows = odd_rows()
    df = frame(spark, rows, extra)
    assert sorted(map(tuple, prefix_trie(df).collect()), key=lambda r: r[:2]) == plain_trie(rows)
    assert sorted(map(tuple, repair(df).collect()), key=lambda r: (r[0] is not None, r[0])) == plain_repair(rows)


@pytest.mark.parametrize("name,plain", [("op11", plain_trie), ("op12", plain_repair)])
def test_queries_on_given_conversations(spark, name, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, query(name)(spark, SF).collect()), key=lambda r: r[:2])
    assert got == plain(rows)


def test_empty_conversations(spark, tmp_path):
    path = table_dir(tmp_path, conversations=frame(spark, []))
    assert query("op11")(spark, path).collect() == []
    assert query("op12")(spark, path).collect() == []


def test_long_conversation_is_parsed_in_blocks(spark):
    """More blocks than one, whole copies of it, and a prefix of it."""
    rng = random.Random(5)
    long = [(t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 4000)}{rng.choice(['.', ''])}") for t in range(9000)]
    rows = [(c, *r) for c in (60, 7) for r in long] + [(8, *r) for r in long[:5000]]
    df = frame(spark, rows)
    assert sorted(map(tuple, repair(df).collect())) == plain_repair(rows)
    got = prefix_trie(df).collect()
    whole = {c: [r[1:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == c] for c in (7, 8, 60)}
    base = {c: zlib.crc32(str(c).encode()) % 4 for c in whole}
    whole = {c: tuple(t if c == 60 or k >= base[c] else None for k, t in enumerate(v)) for c, v in whole.items()}
    whole = {c: tuple(x for x in v if x is not None) for c, v in whole.items()}  # bases 0 are absent
    nodes = {s[:d] for s in [whole[7], whole[8], whole[60]] for d in (0, 1, 2, 5, 100, 4900, 9000 - 3, len(s))}
    by_place = {(r.conv_id, r.depth): r for r in got}
    for node in nodes:
        members = [c for c, s in whole.items() if s[:len(node)] == node]
        assert by_place[min(members), len(node)].n_convs == len(members)
    assert sum(r.n_children == 0 for r in got) == [r for r in got if r.depth == 0][0].n_leaves


def test_cells_equal_a_shortest_path_search():
    rng = random.Random(11)
    kinds = [(i, f) for i in range(4) for f in range(4)]
    cases = [list(p) for n in (0, 1, 2) for p in product(kinds, repeat=n)]
    cases += [[rng.choice(kinds) for _ in range(rng.randint(3, 40))] for _ in range(300)]
    for case in cases:
        codes = "".join(grammar.CODES[4 * i + f] for i, f in case)
        rows = [("sua?"[i], f in (grammar.BLANK, grammar.DUPLICATE), f == grammar.TRUNCATED) for i, f in case]
        assert grammar.cheapest(grammar.parse_codes(codes)) == plain_parse(rows), codes


def test_every_split_of_a_span_gives_the_same_cell():
    """The full chart of a CYK parse, all splits of all spans, against one split a span."""
    rng = random.Random(2)
    for _ in range(40):
        codes = "".join(rng.choice(grammar.CODES) for _ in range(9))
        chart = {(k, k + 1): grammar.terminal(c) for k, c in enumerate(codes)}
        for width in range(2, len(codes) + 1):
            for lo in range(len(codes) - width + 1):
                joined = {grammar.join(chart[lo, m], chart[m, lo + width]) for m in range(lo + 1, lo + width)}
                assert len(joined) == 1
                chart[lo, lo + width] = joined.pop()
        assert chart[0, len(codes)] == grammar.parse_codes(codes)


def test_running_sums_cross_blocks(spark):
    df = spark.range(10_000).selectExpr("id % 2 as g", "id div 2 as p", "id as a", "1L as b", "id as keep")
    got = {(r.g, r.p): (r.a, r.b, r.keep) for r in running_sums(df, "g", "p", ("a", "b")).collect()}
    totals = {0: 0, 1: 0}
    for i in range(10_000):
        totals[i % 2] += i
        assert got[i % 2, i // 2] == (totals[i % 2], i // 2 + 1, i)
