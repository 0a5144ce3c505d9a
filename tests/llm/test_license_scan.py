"""License scan against plain Python, without the keyword prefilter."""

from __future__ import annotations

import random
import re
import time

from llm_helpers import SF, documents, query, table_dir

from residuum.llm.license_rules import BASE, rules
from residuum.llm.license_scan import scan

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_pattern(pattern):
    pattern = re.sub(r"~(?: ~)* ", lambda m: "(?:[^ ]+ ){0,%d}" % (4 * m[0].count("~")), pattern)
    return re.compile(f"(?<= )(?:{pattern})(?= )")


RULES = [(p, label, plain_pattern(x), c) for p, label, _, x, c in rules()]


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text):
    ws = words(text)
    line, starts, ends, at = " " + "".join(w + " " for w in ws), {}, {}, 1
    for i, w in enumerate(ws):
        starts[at], ends[at + len(w)] = i, i + 1
        at += len(w) + 1
    found = [(starts[m.start()], ends[m.end()], label, p, c) for p, label, x, c in RULES for m in x.finditer(line)]
    kept = [d for d in found if not any(e[3] < d[3] and e[0] <= d[0] and e[1] >= d[1] for e in found)]
    kept.sort(key=lambda d: (d[0], -d[1], d[3]))
    base = [(i, label) for phrase, label in BASE for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split()]
    labels = {b[1] for b in base}
    return (len(ws), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {d[2] for d in kept})),
            max([d[4] for d in kept] + [0.5] * bool(base) + [0.0]), kept)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

TEXTS = [
    None, "", " \t\n", "...", "plain words only", "CC BY", "cc-by CC BY cc by", "cc by nc", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. All rights reserved.", "General Public License general public license",
    "accby general public licenses all rights reserve", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Foo-1",
    "GNU Affero General Public License as published by them, version 3", "KELVIN KK CC BY cc by", "droits réservés Tous droits réservés",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so", "x" * 200_000, "all rights reserved " * 3000, "\x00\x01cc\x02by\x01", "😀 cc by 😀".encode("utf-16", "surrogatepass").decode("utf-16"),
]


def check(spark, texts):
    got = scan(documents(spark, texts), keep=("doc_id", "text")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (*(r[c] for c in COLUMNS), [tuple(d) for d in r.detections]) == plain_scan(r.text), (r.text or "")[:200]


def test_scan_of_written_texts(spark):
    check(spark, TEXTS + TEXTS[:6])


def sample(pattern, rng):
    """A text that a rule's pattern matches, by choosing in its syntax tree."""
    from re import _parser

    def walk(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "z"
            elif name == "BRANCH":
                out += walk(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += walk(arg[-1])
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                out += "".join(walk(inner) for _ in range(rng.randint(low, min(int(high), low + 3))))
            elif name == "IN":
                choice = rng.choice([a for a in arg if str(a[0]) != "NEGATE"])
                out += "z" if str(arg[0][0]) == "NEGATE" else chr(choice[1] if str(choice[0]) == "LITERAL" else rng.randint(*choice[1]))
        return out
    return walk(_parser.parse(pattern.pattern))


def test_every_rule_is_found_through_its_keyword(spark):
    """Texts made from each pattern hold its keyword, and overlaps are resolved as in plain Python."""
    rng = random.Random(8)
    texts = []
    for (_, _, pattern, _), (_, _, keyword, _, _) in zip(RULES, rules()):
        for _ in range(6):
            made = sample(pattern, rng)
            assert keyword in words(made), (keyword, made)
            texts.append(made.title())
    mixed = [" ".join(rng.choice(texts) for _ in range(rng.randint(2, 12))) for _ in range(150)]
    check(spark, texts + mixed)


def test_rules_are_hundreds_and_well_formed():
    table = rules()
    assert len(table) >= 200 and [r[0] for r in table] == list(range(len(table)))
    assert all(0 < c <= 1 and "," not in label and re.fullmatch(WORD, k) for _, label, k, _, c in table)


def test_many_matches_take_linear_time(spark):
    t = time.time()
    r = scan(documents(spark, ["cc by mit license " * 40_000])).first()
    assert r.n_base == 40_000 and r.last_word == 4 * 39_999 and len(r.detections) >= 40_000
    assert time.time() - t < 60


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = query("op13")(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|MapInPandas", plan)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    from pyspark.sql import functions as F
    df = documents(spark, ["cc by", None]).select("*", *[F.lit(1).alias(c) for c in ("word_text", "found", "matching", "spans", "score", "base0", "n_words")])
    assert [r.n_base for r in scan(df).orderBy("doc_id").collect()] == [1, 0]
    assert query("op13")(spark, table_dir(tmp_path, documents=documents(spark, []))).collect() == []
