"""Queries over ``conversations`` and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from residuum.llm import conversation_repair, prefix_trie
from residuum.llm.common import table
from residuum.llm.registry import query


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string expression, a bit at a time."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || {steps}, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) "
            "WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))")


@query("op11_prefix_trie", f"""
WITH own AS (
  SELECT conv_id AS c, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS i, digest
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 20 AS base, {crc32_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT v.c, 0 AS part, o.i, o.digest, o.text FROM convs v JOIN own o ON o.c = v.base AND o.i < v.h
  UNION ALL SELECT v.c, 1, o.i, o.digest, o.text FROM convs v JOIN own o ON o.c = v.c AND o.i >= v.h),
seqs AS (
  SELECT c, coalesce(list(digest ORDER BY part, i) FILTER (WHERE digest IS NOT NULL), []) AS ds,
         coalesce(list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY part, i) FILTER (WHERE digest IS NOT NULL), []) AS ws
  FROM convs LEFT JOIN turns USING (c) GROUP BY c),
prefixes AS (
  SELECT c, d AS depth, array_to_string(ds[1:d], '') AS key, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ds) AS ends
  FROM seqs, unnest(range(0, len(ds) + 1)) AS t(d)),
nodes AS (
  SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth),
kids AS (SELECT key[1:len(key) - 64] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sub AS (
  SELECT u.key, sum((v.n_convs - 1) * v.w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves
  FROM nodes u JOIN nodes v ON starts_with(v.key, u.key) LEFT JOIN kids k ON k.key = v.key GROUP BY u.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM nodes n JOIN sub USING (key) LEFT JOIN kids USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.key = n.key[1:len(n.key) - 64]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


_KEY_SQL = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"


@query("op12_conversation_repair", f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY_SQL)} % 20 AS k
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i
  FROM hurt),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
inserts(p, r, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'),
  (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
moves(r, put, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)),
steps AS (
  SELECT f.conv_id, f.i, s.p, m.q,
         s.c + CASE WHEN put = '' THEN 3 ELSE CASE WHEN put = initial THEN 0 ELSE 2 END + CASE WHEN fault = 't' THEN 1 ELSE 0 END END AS c,
         s.a || CASE WHEN put = '' THEN 'D' WHEN put = initial THEN 'K' ELSE 'R' END AS a
  FROM faulty f, inserts s JOIN moves m USING (r)
  WHERE put = '' OR (fault NOT IN ('b', 'd') AND (put = initial OR put <> 's'))),
cells AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(cost := 0, audit := '') AS best FROM facts
  UNION ALL
  SELECT x.conv_id, x.i + 1, e.q, min(struct_pack(cost := x.best.cost + e.c, audit := x.best.audit || e.a))
  FROM cells x JOIN steps e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.i = x.i + 1 AND e.p = x.q GROUP BY x.conv_id, x.i, e.q),
chosen AS (
  SELECT f.conv_id, min(struct_pack(cost := x.best.cost + s.c, audit := x.best.audit || s.a)) AS best
  FROM facts f JOIN cells x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.n JOIN inserts s ON s.p = x.q
  WHERE s.r IN (0, 3) GROUP BY f.conv_id),
edits AS (
  SELECT conv_id, j, substr(best.audit, j, 1) AS edit, length(replace(best.audit[1:j], 'I', '')) AS i, length(replace(best.audit[1:j], 'D', '')) AS m
  FROM chosen, unnest(range(1, length(best.audit) + 1)) AS t(j)),
opened AS (
  SELECT e.conv_id FROM edits e JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i
  WHERE e.m = 1 AND e.edit = 'K' AND f.initial = 's'),
lines AS (
  SELECT e.conv_id, e.j,
         CASE WHEN edit = 'K' THEN f.role WHEN (m + CASE WHEN EXISTS (SELECT 1 FROM opened o WHERE o.conv_id IS NOT DISTINCT FROM e.conv_id) THEN 1 ELSE 0 END) % 2 = 1
              THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D'),
told AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS said FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.best.cost, 0)::BIGINT AS cost,
       coalesce(x.best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))
