"""Weighted CYK parsing of conversations against the grammar of repaired ones.

A repaired conversation spells ``(s?(ua)+)?`` with its role initials. That language is
regular, so the nonterminals of its grammar in Chomsky normal form are pairs of states
``[p,q]`` ("from p, with what this span puts out, to q"), the states being the last role
put out: none, s, u, a. Its rules are ``[p,q] -> [p,r] [r,q]``, and ``[p,q] -> row`` by
keeping, reroling or deleting the row. The insertion closure holds what ``[p,q]`` costs
over no row at all; it is laid on both sides of each row.

The cell of a span has for each nonterminal the least ``(cost, audit)``, audits compared
as text. Two audits of one span and cost are never prefix of one another (both edit all
rows; a longer one has dearer insertions), so least parts make the least whole. All ways
to bracket ``[p,r] [r,q] ...`` are in the grammar and give the same cell, so spans are
joined bottom-up in widths 1, 2, 4, ... with one split each: n rows take n - 1 joins.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"              # any other initial is class 3
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
CODES = "abcdefghijklmnop"    # 4 * class of the initial + fault
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATION = 1

NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = ((NONE, NONE), (NONE, ASSISTANT))
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or (q > p and q > NONE) or (p, q) == (ASSISTANT, USER)]
AT = {pair: k for k, pair in enumerate(PAIRS)}
RULES = [(AT[p, q], AT[p, r], AT[t, q]) for p, r in PAIRS for t, q in PAIRS if r == t and (p, q) in AT]
LEGAL = ("su", "ua", "au")

Cell = tuple  # one (cost, audit) or None for each of PAIRS


def join(left: Cell, right: Cell) -> Cell:
    out: list = [None] * len(PAIRS)
    for whole, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        found, cost = out[whole], x[0] + y[0]
        if found is None or cost < found[0] or (cost == found[0] and x[1] + y[1] < found[1]):
            out[whole] = (cost, x[1] + y[1])
    return tuple(out)


def _cell(entries: dict) -> Cell:
    return tuple(entries.get(pair) for pair in PAIRS)


@functools.cache
def closure() -> Cell:
    """Insertions only: nothing, then one, two, three rows more until no cell improves."""
    nothing = _cell({(p, p): (0, "") for p in range(4)})
    one = _cell({(p, p): (0, "") for p in range(4)} | {
        (p, q): (COST[INSERT], INSERT) for (p, initial), q in NEXT.items() if initial in "ua"})
    cell = nothing
    while (more := join(cell, one)) != cell:
        cell = more
    return cell


@functools.cache
def terminal(code: str) -> Cell:
    """The cell of one row."""
    initial, fault = divmod(CODES.index(code), 4)
    entries = {(p, p): (COST[DELETE], DELETE) for p in range(4)}
    if fault in (FINE, TRUNCATED):
        extra = TRUNCATION if fault == TRUNCATED else 0
        for (p, role), q in NEXT.items():
            if initial < 3 and INITIALS[initial] == role:
                entries[p, q] = (COST[KEEP] + extra, KEEP)
            elif role in "ua":
                entries[p, q] = (COST[REROLE] + extra, REROLE)
    return join(join(closure(), _cell(entries)), closure())


def parse(cells: Sequence[Cell]) -> Cell:
    """The cell of consecutive spans (the closure where there is none)."""
    cells = list(cells) or [closure()]
    while len(cells) > 1:
        joined = [join(cells[k], cells[k + 1]) for k in range(0, len(cells) - 1, 2)]
        cells = joined + cells[len(joined) * 2:]
    return cells[0]


@functools.lru_cache(maxsize=1 << 14)
def _short(codes: str) -> Cell:
    return parse([terminal(c) for c in codes])


def parse_codes(codes: str) -> Cell:
    return _short(codes) if len(codes) <= 32 else parse([terminal(c) for c in codes])


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[AT[pair]] for pair in ACCEPTED if cell[AT[pair]] is not None)


def illegal(codes: str) -> int:
    """Adjacent rows whose initials are none of ``LEGAL``."""
    initials = ["sua?"[CODES.index(c) // 4] for c in codes]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


class Replay:
    """Follows an audit along the rows of a conversation and says what each edit puts out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NONE

    def _due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> list[str]:
        """``role:`` of the rows inserted here, before the next row or the end."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            out.append(self._put(self._due()) + ":")
            self.at += 1
        return out

    def _put(self, role: str) -> str:
        self.state = NEXT[self.state, role[:1]]
        return role

    def row(self, role: str, text: str) -> str | None:
        """What the next row becomes (``None``: deleted)."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return None
        return self._put(role if edit == KEEP else self._due()) + ":" + text
