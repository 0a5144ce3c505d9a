"""Toxicity by compression distance with zstandard dictionaries.

zstandard's dictionary trainer is run twice: on the windows of ordinary texts, and on
windows of toxic texts, those around n-grams that toxic texts hold significantly more
often than ordinary ones. The ordinary dictionary goes before the toxic one as well,
so common language compresses alike under either. A text is cut into windows of about ``WINDOW`` bytes at spaces, and each window is
compressed with both: the bytes saved by the toxic dictionary are its gain.

Thresholds are calibrated on labelled texts that the dictionaries have not seen:
each gain gets the log of how much likelier it is in toxic texts, the logs are
summed over all windows of a text, and a logistic curve turns sum and mean into a
score. The curve is placed so that ``DECISION`` is the threshold of best F score (with
``BETA``) on those texts, at the class shares of the labels.

Learning reads at most ``SAMPLE`` labelled texts of each class (drawn by a hash of
the id), those of at most ``MAX_CHARS`` characters; every window of every text is
scored. A document with several labels counts as toxic if one says so.

Null and blank texts have no windows and get the curve's value there. If a class
has no texts to learn from, every score is 0. Every input row gives one output row,
repeated rows and null ids included; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 3000           # labelled texts of each class
MAX_CHARS = 12_000      # longer texts are not learned from; 72 MB are collected at most
WINDOW = 64             # bytes, to the next space
GRAM = 6                # bytes of the n-grams by which toxic windows are found
MIN_Z, MIN_RATIO = 6.0, 4.0   # how far an n-gram must be commoner in toxic texts
BASE_BYTES = 60_000     # of segments that both dictionaries share
TOXIC_BYTES = 4_000     # of segments of toxic text
MARGIN, TRAIN_SEGMENT, TRAIN_GRAM = 2, 24, 6   # of the trainer: bytes around marked n-grams, and its segments
BETA = 1.5              # recall is so many times as important as precision
DECISION = 0.7          # score from which a text is meant to count as toxic
GAINS = (-3, 8)         # gains beyond are taken as these


def normal(text: str | None) -> bytes:
    """Lower-case UTF-8 with one space between words."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").split())


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in pieces of at least ``size`` bytes, cut after a space; a
    word that does not end is cut at eight times the size."""
    out, lo, n = [], 0, len(text)
    while lo < n:
        hi = text.find(b" ", lo + size, lo + 8 * size)
        hi = (min(n, lo + 8 * size) if hi < 0 else hi)
        if hi + 1 >= n or n - lo <= size:
            hi = n if n - lo <= 8 * size else hi
        out.append(b" " + text[lo:hi] + b" ")
        lo = hi
    return out


def _grams(text: bytes) -> np.ndarray:
    """The GRAM bytes at each place as one number."""
    a = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h << np.uint64(8)) | a[i:n + i]
    return h


def _doc_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts] or [np.zeros(0, np.uint64)]),
                     return_counts=True)


def telling_windows(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Windows of toxic text around runs of n-grams that are marked by their document counts."""
    gram, in_toxic = _doc_counts(toxic)
    other, count = _doc_counts(ordinary)
    at = np.minimum(np.searchsorted(other, gram), max(0, len(other) - 1))
    in_ordinary = np.where(other[at] == gram, count[at], 0) if len(other) else np.zeros(len(gram))
    a, b = len(toxic), len(ordinary)
    p = (in_toxic + in_ordinary) / (a + b)
    z = (in_toxic / a - in_ordinary / b) / np.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
    marked = gram[(z >= MIN_Z) & (in_toxic / a >= MIN_RATIO * (in_ordinary + 1) / b)]
    parts = []
    for t in toxic:
        hit = np.flatnonzero(np.isin(_grams(t), marked))
        if len(hit):
            padded = b" " + t + b" "
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > MARGIN) + 1):
                parts.append(padded[max(0, run[0] - MARGIN):run[-1] + GRAM + MARGIN])
    return parts


def trained(parts: list[bytes], size: int) -> bytes:
    """The content that zstandard's dictionary trainer makes of samples."""
    try:
        return zstandard.train_dictionary(size + 1000, parts, k=TRAIN_SEGMENT, d=TRAIN_GRAM).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on: take it as it is
        return b"".join(parts)[-size:] or b" " * 8


class Model:
    def __init__(self, toxic: list[bytes], ordinary: list[bytes], share: float):
        """``share``: of label 1 among the labels. Every second text trains the
        dictionaries, the others calibrate."""
        self.ready = len(toxic) >= 2 and len(ordinary) >= 2
        if not self.ready:
            return
        base = trained([w for t in ordinary[::2] for w in windows(t)], BASE_BYTES)
        self.dictionaries = (base, base + trained(telling_windows(toxic[::2], ordinary[::2]), TOXIC_BYTES))
        self._open()
        found = [[self.gains(t) for t in texts[1::2]] for texts in (toxic, ordinary)]
        span = GAINS[1] - GAINS[0] + 1
        freq = [np.bincount(np.concatenate(g), minlength=span) + 1.0 for g in found]
        self.weight = np.log(freq[0] / freq[0].sum()) - np.log(freq[1] / freq[1].sum())
        x = np.array([self.features(g) for side in found for g in side])
        y = np.repeat([1.0, 0.0], [len(found[0]), len(found[1])])
        w = np.where(y == 1, share / len(found[0]), (1 - share) / len(found[1])) * len(y)
        self.curve = logistic(x, y, w)
        self.curve[0] += np.log(DECISION / (1 - DECISION)) - best_cut(self.curve[0] + (x * self.curve[1:]).sum(axis=1), y, w)

    def _open(self) -> None:
        made = []
        for d in self.dictionaries:
            how = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=WINDOW, dict_size=len(d), min_match=5, strategy=zstandard.STRATEGY_LAZY2,
                write_checksum=False, write_content_size=False, write_dict_id=False)
            z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=z, compression_params=how).compress)
        self.ordinary, self.toxic = made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ordinary", "toxic")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if self.ready:
            self._open()

    def gains(self, text: bytes) -> np.ndarray:
        """Bytes saved by the toxic dictionary in each window, from 0 for the least."""
        ordinary, toxic = self.ordinary, self.toxic
        return np.clip(np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64), *GAINS) - GAINS[0]

    def features(self, gains: np.ndarray) -> tuple[float, float]:
        w = self.weight[gains]
        return (float(np.clip(w.sum(), -30, 30)), float(w.mean())) if len(w) else (0.0, 0.0)

    def score(self, text: bytes) -> float:
        if not self.ready:
            return 0.0
        z = self.curve[0] + np.dot(self.curve[1:], self.features(self.gains(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip((x * b).sum(axis=1), -30, 30)))
        h = np.einsum("ni,n,nj->ij", x, w * p * (1 - p), x) + ridge * np.eye(len(b))
        step = solved(h, (x * (w * (y - p))[:, None]).sum(axis=0) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a small positive definite system, by elimination (a threaded
    BLAS in the driver can deadlock next to the JVM gateway)."""
    m = np.column_stack([a, b])
    for i in range(len(b)):
        m[i] /= m[i, i]
        for j in range(len(b)):
            if j != i:
                m[j] -= m[j, i] * m[i]
    return m[:, -1]


def best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut of best weighted F score (recall ``BETA`` times as important as precision),
    half way to the next lower value."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hit, taken = np.cumsum(w * y), np.cumsum(w)
    last = np.append(z[:-1] > z[1:], True)  # equal values are taken together
    f1 = np.where(last, (1 + BETA ** 2) * hit / (taken + BETA ** 2 * (w * y).sum()), -1)
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i]) - 1.0


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: ``id, text``; ``labels``: ``id, label``."""
    by_id = labels.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)) \
        .groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id"))
    shares = {r["label"]: r["count"] for r in by_id.groupBy("label").count().collect()}
    # about twice the rows needed are drawn by their hash, so that few are ranked
    drawn = {k: min(1.0, 2 * SAMPLE / n) for k, n in shares.items()}
    share = F.when(F.col("label") == 1, drawn.get(1, 0.0)).otherwise(drawn.get(0, 0.0))
    nth = Window.partitionBy("label").orderBy("h", "id")
    chosen = by_id.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < share * (1 << 30)).withColumn("k", F.row_number().over(nth)).filter(F.col("k") <= SAMPLE).select("id", "label", "h")
    # at most 2 * SAMPLE rows: bounded, so they are broadcast and their texts collected
    texts = docs.filter(F.length("text") <= MAX_CHARS).join(F.broadcast(chosen), "id") \
        .groupBy("id", "label", "h").agg(F.min("text").alias("text")).orderBy("h", "id").collect()
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    for text, label in dict.fromkeys((normal(r["text"]), r["label"]) for r in texts):  # copies teach nothing new
        if text:
            by_label[label].append(text)
    return Model(by_label[1], by_label[0], shares.get(1, 0) / max(1, sum(shares.values())))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).alias("_text"), *keep)

    def run(batches):
        judge = shared.value.score
        for b in batches:
            scores = [judge(normal(t.as_py())) for t in b.column(0)]
            yield pa.record_batch([*b.columns[1:], pa.array(scores, pa.float64())], [*b.schema.names[1:], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, ", ".join(x for x in (fields, "score double") if x))
