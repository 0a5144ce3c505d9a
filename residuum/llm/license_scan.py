"""License scan by ordered signature rules, in Spark SQL functions only.

A text becomes its words, each with a space on both sides (`` cc  by ``), so a pattern
takes whole words and matches next to each other share no character. For each row:

1. keyword prefilter: the rules' keywords that occur as words;
2. the rules of these keywords that match at all, then the word spans of their matches
   (marked in the text, cut at the marks, words counted between them);
3. suppression: of overlapping detections, one inside the span of an earlier rule's goes.
   Detections are folded in order of start, the longer first; only those that reach past
   the next start are looked at, at most one for each rule.

There is no shuffle; a row's work arrays hold its matches, not copies of its text. Folds
go by blocks of ``BLOCK`` entries, so results of many matches are not copied at each.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.license_rules import BASE, BASE_CONFIDENCE, rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, CLOSE = "\x01", "\x02"   # marks around a match; no word holds them
BLOCK = 512
RULE = "array<struct<priority:int,label:string,keyword:string,pattern:string,confidence:double>>"
SPAN = "struct<start:bigint,shorter:bigint,priority:int,label:string,confidence:double>"


def spaced(phrase: str) -> str:
    """A phrase or pattern of words with one space between them, as texts are spaced."""
    return f" {phrase.replace(' ', '  ')} "


def compiled(pattern: str) -> str:
    """``~`` runs become gaps of up to four words each."""
    gaps = re.sub(r"~(?: ~)* ", lambda m: f"(?:[^ ]+ ){{0,{4 * m[0].count('~')}}}", pattern)
    wrapped = f"(?:{gaps})" if "|" in gaps else gaps
    return spaced(wrapped).replace("[^  ]", "[^ ]")


def word_text(text: Column) -> Column:
    """The words of a text (null: empty), each with a space on both sides."""
    words = F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def n_words(text: str) -> str:
    """SQL: words of a stretch of a word text."""
    return f"((length({text}) - length(replace({text}, ' ', ''))) div 2)"


def _folded(items: str, start: str, step: str, out: str) -> str:
    """SQL: fold ``items`` (as ``x``) with state ``a``, a struct with the list ``out``;
    lists of a block are put together before they are added to the whole."""
    blocks = f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), b -> slice({items}, b * {BLOCK} + 1, {BLOCK}))"
    block = f"aggregate(xs, named_struct('s', w.s, '{out}', slice(w.{out}, 1, 0)), (a, x) -> {step})"
    return (f"aggregate({blocks}, {start}, (w, xs) -> transform(array({block}), "
            f"d -> named_struct('s', d.s, '{out}', concat(w.{out}, d.{out})))[0], w -> w.{out})")


def _spans(rule: str) -> str:
    """SQL: spans of a rule's matches in ``word_text``, in order."""
    parts = f"split(regexp_replace(word_text, {rule}.pattern, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    match = f"split_part(x, '{CLOSE}', 1)"
    span = (f"named_struct('start', a.s, 'shorter', -(a.s + {n_words(match)}), 'priority', {rule}.priority, "
            f"'label', {rule}.label, 'confidence', {rule}.confidence)")
    step = f"named_struct('s', a.s + {n_words('x')}, 'spans', concat(a.spans, array({span})))"
    start = f"named_struct('s', cast({n_words('p[0]')} as bigint), 'spans', cast(array() as array<{SPAN}>))"
    folded = _folded("slice(p, 2, greatest(size(p) - 1, 1))", start, step, "spans")
    return f"transform(array({parts}), p -> {folded})[0]"


def _kept() -> str:
    """SQL: ``spans`` without those inside a span of an earlier rule."""
    alive = "filter(a.s, y -> -y.shorter > x.start)"
    inside = "exists(a.s, y -> y.priority < x.priority and y.shorter <= x.shorter)"
    step = (f"named_struct('s', concat({alive}, array(x)), "
            f"'kept', if({inside}, a.kept, concat(a.kept, array(x))))")
    empty = f"cast(array() as array<{SPAN}>)"
    return f"if(size(spans) = 0, spans, {_folded('spans', f'named_struct({chr(39)}s{chr(39)}, {empty}, {chr(39)}kept{chr(39)}, {empty})', step, 'kept')})"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels`` of
    the base phrases; ``detections``, the spans ``[start, end)`` in words of the rules'
    matches that are left, with label, rule and confidence; ``labels`` of base phrases and
    detections; ``score``, the highest confidence among them (0: none).

    A null text is empty, and a text without words has no places, empty labels and score
    0. Rows are judged one by one: repeated rows, null or repeated ids and extra columns
    make no difference."""
    table = [dict(priority=p, label=label, keyword=k, pattern=compiled(x), confidence=c) for p, label, k, x, c in rules()]
    keywords = sorted({r["keyword"] for r in table})
    out = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], word_text(F.col("text")).alias("word_text"))
    kept = [f"_keep{i}" for i in range(len(keep))]

    found = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("word_text"), F.concat(F.lit(" "), k, F.lit(" "))))
    base = [F.when(F.contains(F.col("word_text"), F.lit(spaced(p))), F.split("word_text", spaced(p), -1)).alias(f"base{i}")
            for i, (p, _) in enumerate(BASE)]
    out = out.select(*kept, "word_text", F.expr(n_words("word_text")).cast("long").alias("n_words"), found.alias("found"), *base)

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    first = [F.expr(n_words(f"base{i}[0]")) for i in range(len(BASE))]
    last = [F.col("n_words") - len(p.split()) - F.expr(n_words(f"element_at(base{i}, -1)")) for i, (p, _) in enumerate(BASE)]
    labels = F.array_compact(F.array(*[F.when(F.col(f"base{i}").isNotNull(), label) for i, (_, label) in enumerate(BASE)]))
    literal = F.from_json(F.lit(json.dumps(table)), RULE)
    named = F.filter(literal, lambda r: F.array_contains("found", r["keyword"]) & F.rlike(F.col("word_text"), r["pattern"]))
    matching = F.when(F.size("found") > 0, named).otherwise(F.from_json(F.lit("[]"), RULE))
    out = out.select(*kept, "word_text", "n_words", labels.alias("base_list"), matching.alias("matching"),
                     sum((F.coalesce(F.size(f"base{i}") - 1, F.lit(0)) for i in range(len(BASE))), F.lit(0)).cast("long").alias("n_base"),
                     F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"))
    out = out.select(*kept, "n_words", "n_base", "first_word", "last_word", "base_list",
                     F.expr(f"array_sort(flatten(transform(matching, r -> {_spans('r')})))").alias("spans"))
    out = out.withColumn("spans", F.expr(_kept()))
    seen = F.transform("spans", lambda d: d["confidence"])
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)], "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base_list")).alias("base_labels"),
        joined(F.concat("base_list", F.transform("spans", lambda d: d["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(seen), F.lit(0.0)),
                   F.when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        F.transform("spans", lambda d: F.struct(d["start"].alias("start"), (-d["shorter"]).alias("end"), d["label"].alias("label"),
                                                d["priority"].alias("rule"), d["confidence"].alias("confidence"))).alias("detections"))
