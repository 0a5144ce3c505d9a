"""Query of the license scan and its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from residuum.llm import license_scan
from residuum.llm.common import table
from residuum.llm.license_rules import BASE, BASE_CONFIDENCE, rules
from residuum.llm.registry import query

_RULES = ", ".join(f"({p}, '{label}', '{k}', '{license_scan.compiled(x)}', {c})" for p, label, k, x, c in rules())
_BASE = ", ".join(f"('{license_scan.spaced(p)}', '{label}')" for p, label in BASE)


def _words(text: str) -> str:
    return f"((length({text}) - length(replace({text}, ' ', ''))) // 2)"


@query("op13_license_scan", f"""
WITH rules(priority, label, keyword, pattern, confidence) AS (VALUES {_RULES}),
base(phrase, label) AS (VALUES {_BASE}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS w
  FROM (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ') AS w FROM documents)),
places AS (
  SELECT rid, label, {_words("array_to_string(parts[1:k], '')")} + (k - 1) * {_words("phrase")} AS start
  FROM (SELECT rid, label, phrase, string_split(w, phrase) AS parts FROM d, base WHERE contains(w, phrase)), unnest(range(1, len(parts))) AS t(k)),
cut AS (
  SELECT rid, priority, label, confidence, string_split(regexp_replace(w, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts
  FROM d JOIN rules ON contains(w, ' ' || keyword || ' ') AND regexp_matches(w, pattern)),
spans AS (
  SELECT rid, priority, label, confidence, {_words("array_to_string(parts[1:k], '')")} AS start,
         {_words("array_to_string(parts[1:k], '')")} + {_words("string_split(parts[k + 1], chr(2))[1]")} AS stop
  FROM cut, unnest(range(1, len(parts))) AS t(k)),
kept AS (
  SELECT * FROM spans x WHERE NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.rid = x.rid AND y.priority < x.priority AND y.start <= x.start AND y.stop >= x.stop)),
b AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM places GROUP BY rid),
l AS (
  SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score
  FROM (SELECT rid, label, confidence FROM kept UNION ALL SELECT rid, label, {BASE_CONFIDENCE} FROM places) GROUP BY rid)
SELECT doc_id, {_words("w")} AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
""")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")
