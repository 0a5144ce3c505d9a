"""Main text of web pages: flat blocks, neighbour features, a decision tree.

A page becomes a flat list of text blocks (``html_blocks``). Each block has its
word count and link density, those of the blocks before and after it, and what its
open elements say (furniture such as navigation, notices or reader comments;
article; heading; list item or cell). A decision tree trained on the small table of
labelled blocks in ``html_labels`` tells main text from the rest. The main blocks,
joined by an empty line in page order, are the text: whole, without a cap.

Character references are decoded, white space inside a block becomes one space,
``<br>`` counts as white space. A null, empty or text-free page has an empty text.
Every input row gives one output row, repeated rows and null ids included; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.llm.html_blocks import Block, blocks, features
from residuum.llm.html_labels import labelled_blocks

MAX_DEPTH = 8
MIN_ROWS = 1


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
        self.nodes: list[tuple] = []  # (feature, cut, left, right) or (None, label)
        self._grow(np.asarray(x, float), np.asarray(y, float), depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((None, bool(y.mean() >= 0.5)))
        split = self._split(x, y) if depth and 0 < y.mean() < 1 else None
        if split:
            f, cut = split
            low = x[:, f] <= cut
            self.nodes[at] = (f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))
        return at

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray):
        best = None
        n = len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            a, b = ones[:-1], ones[-1] - ones[:-1]
            loss = a * (k - a) / k + b * (n - k - b) / (n - k)
            loss[(v[1:] == v[:-1]) | (k < MIN_ROWS) | (n - k < MIN_ROWS)] = np.inf
            i = int(loss.argmin())
            if np.isfinite(loss[i]) and (best is None or loss[i] < best[0] - 1e-12):
                best = (loss[i], f, (v[i] + v[i + 1]) / 2)
        return best[1:] if best else None

    def __call__(self, row: Sequence[float]) -> bool:
        node = self.nodes[0]
        while node[0] is not None:
            node = self.nodes[node[2] if row[node[0]] <= node[1] else node[3]]
        return node[1]


def trained() -> Tree:
    rows, labels = labelled_blocks()
    return Tree(np.array(rows, float), np.array(labels, float))


def main_blocks(page: str, tree: Tree) -> list[Block]:
    found = blocks(page)
    return [b for b, row in zip(found, features(found)) if tree(row)]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` for each row of ``pages``."""
    tree = trained()
    src = pages.select(F.col(html_col).alias("_html"), *keep)

    def run(batches):
        for b in batches:
            text = ["\n\n".join(m.text for m in main_blocks(h.as_py() or "", tree)) for h in b.column(0)]
            yield pa.record_batch([*b.columns[1:], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                                  [*b.schema.names[1:], "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, ", ".join(x for x in (fields, "text string, n_chars bigint") if x))
