"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
against it from left to right into phrases, each the longest match at its place;
the language that needs the fewest phrases, normalised as bits for each character
(``phrases * log2(reference length) / characters``), wins.

Texts are reduced to lower-case letters with one space between words and parsed
in windows of ``WINDOW`` characters, so a worker parses thousands of windows at
once: one step of table look-ups advances every window in every language. Every character
of every text is parsed.

Learning reads at most ``SAMPLE_ROWS`` labelled texts of each language (drawn by their
hash), ``SAMPLE_CHARS`` characters from the middle of each; with many languages fewer of
each, so that all share ``MAX_CHARS`` characters evenly and none is left out. More than
``MAX_LANGS`` languages are an error. The automata's transitions, about three for each
character, lie in one table that is broadcast: 60 bytes a character, 60 MB at most,
whatever the alphabets.

A null text, or one without letters, gets ``und`` and score 0; so does every text
if nothing could be learned. Ties go to the first language by name. The score is
the margin to the runner-up, from 0.5 (tie) towards 1, or 1 if only one language
is known. Every input row gives one output row, repeated rows and null ids
included; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.llm.common import as_binary, give_back, slices

WINDOW = 256
SAMPLE_ROWS = 160
SAMPLE_CHARS = 160
MAX_CHARS = 1_000_000
MAX_LANGS = 512
LANES = 4096
TEXT_BYTES = 1 << 20  # of text turned into codes at once
UNKNOWN = "und"
SPACE, OTHER = 0, 1  # codes: word break, letter that no sample holds; then the letters


def letters(text: str) -> str:
    """Lower-case letters, runs of anything else as one space, trimmed."""
    return " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())


class SuffixAutomaton:
    """States and transitions that accept exactly the substrings of a text."""

    def __init__(self, codes):
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:  # split: the shorter strings of q get a state of their own
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Transitions:
    """Automata in one table by row displacement: state ``s`` has its transition by ``c``
    at ``base[s] + c``, if the entry there names ``s``. States of many transitions look
    for a place first; those of one go where room is left. So the table grows with the
    transitions, not with states times alphabet."""

    FILL = 0.4

    def __init__(self, edges: list[dict], width: int):
        size = width * 2 + int(sum(map(len, edges)) / self.FILL)
        self.base = np.zeros(len(edges), np.int32)
        self.entry = np.full(size + width, -1, np.int64)  # owner << 32 | next state
        taken, rng = np.zeros(size + width, bool), np.random.default_rng(7)
        for s in sorted((s for s, e in enumerate(edges) if len(e) > 1), key=lambda s: -len(edges[s])):
            codes = np.fromiter(edges[s], np.int64, len(edges[s]))
            at = int(rng.integers(size))
            while taken[at + codes].any():
                at = int(rng.integers(size))
            taken[at + codes] = True
            self.base[s] = at
            self.entry[at + codes] = (s << 32) + np.fromiter(edges[s].values(), np.int64, len(codes))
        single = [(s, *next(iter(e.items()))) for s, e in enumerate(edges) if len(e) == 1]
        if single:
            s, c, to = np.array(single, np.int64).T
            free = np.flatnonzero(~taken[:size])
            free = free[free >= width][:len(s)]  # so that no base is negative
            self.base[s] = free - c
            self.entry[free] = (s << 32) + to


class Model:
    """The automata of all languages, and how windows are parsed against them."""

    PHRASE = 1 << 30

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(k for k, v in samples.items() if v)
        alphabet = sorted({c for v in samples.values() for c in v} - {" "})
        self.code_of = np.full(0x110000, SPACE, np.int32)
        self.known = {c: i + 2 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 3
        self.pad = self.width - 1
        for cp in range(0x110000):
            if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
                low = chr(cp).lower()[0]
                self.code_of[cp] = self.known.get(low, OTHER)
        self.bits = np.array([math.log2(max(2, len(samples[k]))) for k in self.langs])
        # where a phrase begins with each code: the state after it
        self.start = np.zeros((len(self.langs), self.width), np.int32)
        edges: list[dict] = []
        for k, lang in enumerate(self.langs):
            nxt = SuffixAutomaton([SPACE if c == " " else self.known[c] for c in samples[lang]]).next
            at = len(edges)
            edges += [{c: to + at for c, to in e.items()} for e in nxt]
            # the last state follows a character that the sample lacks, which is a
            # phrase of its own: whatever comes next starts another
            self.start[k] = len(edges)
            edges.append({})
            for c, to in nxt[0].items():
                self.start[k, c] = to + at
            self.start[k, self.pad] = at
        if len(edges) >= self.PHRASE:
            raise ValueError("the automata exceed the table's index range")
        table = Transitions(edges, self.width)
        self.base, self.entry = table.base, table.entry
        self.again = self.start | self.PHRASE
        self.again[:, self.pad] = self.start[:, self.pad]

    def phrases(self, windows: np.ndarray) -> np.ndarray:
        """Phrases of each window (rows of codes, padded) in each language."""
        columns = np.ascontiguousarray(windows.T).astype(np.int32)
        count = np.ones((len(self.langs), len(windows)), np.int32)
        state = self.start.take(columns[0], axis=1)
        for c in columns[1:]:
            found = self.entry.take(self.base.take(state) + c)
            goes_on = (found >> 32) == state
            state = np.where(goes_on, found.astype(np.int32), self.again.take(c, axis=1))
            count += state >> 30
            state &= self.PHRASE - 1
        return count

    def judge(self, column) -> tuple[list[str], list[float]]:
        """Language and score of each text of an Arrow column."""
        column = as_binary(column)
        langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
        if not self.langs:
            return langs, scores
        for first, data, off in slices(column, TEXT_BYTES):
            codes, start = self._codes(data, off)
            size = np.diff(start)
            some = np.flatnonzero(size)
            if not len(some):
                continue
            n_win = -(-size // WINDOW)
            row = np.repeat(np.arange(len(size)), n_win)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
            lo = start[row] + nth * WINDOW
            long = np.minimum(WINDOW, start[row + 1] - lo)
            total = np.zeros((len(self.langs), len(size)))
            order = np.argsort(-long, kind="stable")
            for i in range(0, len(order), LANES):
                at = order[i:i + LANES]
                w = int(long[at[0]])
                pos = np.minimum(lo[at][:, None] + np.arange(w), len(codes) - 1)
                grid = np.where(np.arange(w) < long[at][:, None], codes[pos], self.pad)
                for total_l, c in zip(total, self.phrases(grid)):
                    total_l += np.bincount(row[at], weights=c, minlength=len(size))
            cost = total[:, some] * self.bits[:, None] / size[some]
            best = cost.argmin(axis=0)
            if len(self.langs) > 1:
                two = np.partition(cost, 1, axis=0)
                sure = two[1] / (two[0] + two[1])
            else:
                sure = np.ones(len(some))
            for r, b, s in zip(some.tolist(), best.tolist(), sure.tolist()):
                langs[first + r], scores[first + r] = self.langs[b], s
        return langs, scores

    def _codes(self, data: np.ndarray, off: np.ndarray):
        """Codes of all texts, words apart by one SPACE, and where each text starts."""
        point, row = decoded(data, off)
        code = self.code_of[point]
        letter = code != SPACE
        new_row = np.ones(len(row), bool)
        new_row[1:] = row[1:] != row[:-1]
        # a space stays where a letter follows and another came before in the same text
        after = np.zeros(len(code), bool)
        after[:-1] = letter[1:] & ~new_row[1:]
        before = np.concatenate([[0], np.cumsum(letter)])
        first_of_row = np.maximum.accumulate(np.where(new_row, np.arange(len(row)), 0))
        stays = letter | (after & (before[:-1] > before[first_of_row]))
        code, row = code[stays], row[stays]
        return code, np.searchsorted(row, np.arange(len(off)))


def decoded(data: np.ndarray, off: np.ndarray):
    """Code points of UTF-8 text and the text of each."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    row = np.searchsorted(off, at, side="right") - 1
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return point, row


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          key: Column | None = None) -> dict[str, str]:
    """Bounded sample text by language, from rows with text and language."""
    text = F.col(text_col)
    mid = F.greatest(F.lit(1), ((F.length(text) - SAMPLE_CHARS) / 2).cast("int"))
    rows = labelled.filter(text.isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.substr(text, mid, F.lit(SAMPLE_CHARS)).alias("part"),
        F.xxhash64(text, key if key is not None else F.lit(0)).alias("h"))
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if not counts:
        return {}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages among the labels")
    each = max(1, min(SAMPLE_ROWS, MAX_CHARS // SAMPLE_CHARS // len(counts)))
    # about twice the rows needed are drawn by their hash, so that few are ranked
    drawn = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * each + 20) / r["count"]))])
    rows = rows.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.try_element_at(drawn, F.col("lang")) * (1 << 30))
    first = Window.partitionBy("lang").orderBy("h")
    rows = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each)
    parts: dict[str, list[str]] = {}
    for r in rows.orderBy("n", "lang").collect():
        parts.setdefault(r["lang"], []).append(letters(r["part"]))
    return {k: " ".join(v for v in vs if v) for k, vs in parts.items()}


def identify(docs: DataFrame, samples: dict[str, str], keep: tuple[str, ...] = ("doc_id",),
             text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))
    src = docs.select(F.col(text_col).alias("_text"), *keep)

    def run(batches):
        model = shared.value
        for b in batches:
            lang, score = model.judge(b.column(0))
            give_back()
            yield pa.record_batch([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                  [*b.schema.names[1:], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, ", ".join(x for x in (fields, "lang_pred string, score double") if x))


def recognised(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all columns. If none
    could be learned, the rows whose text has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            if model.langs:
                keep = [k != UNKNOWN for k in model.judge(b.column(at))[0]]
            else:
                keep = [bool(letters(t)) for t in b.column(at).to_pylist()]
            give_back()
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
