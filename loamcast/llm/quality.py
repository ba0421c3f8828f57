"""Quality classifier: histogram gradient-boosted trees over text statistics,
flattened into arrays that numpy walks for a whole batch at once."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, text_blocks

SAMPLE = 20_000  # labelled rows that a model is fitted on, about; a documented bound
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 8
CUT = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "upper", "digits", "marks", "exclaims", "spaces", "beyond_ascii",
    "distinct_words", "repeated_next", "top_word", "log_lines", "distinct_lines", "sentence_words", "markup", "byte_entropy", "capitalised", "brackets",
]


def byte_classes() -> np.ndarray:
    """One row a class: upper, digits, marks, exclaims, spaces, beyond_ascii,
    markup, brackets, stops."""
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!", b" \t\n\r\f\v", bytes(range(128, 256)), b"<>&=/#@\\|_", b"()[]{}", b".!?"]
    return np.array([[b in s for b in range(256)] for s in sets], np.float64)


CLASSES = byte_classes()


def statistics(text: str) -> list[float]:
    """FEATURES of one whole text; all finite, for the empty text too."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    size = max(1, len(data))
    upper, digits, marks, exclaims, spaces, beyond, markup, brackets, stops = (CLASSES @ counts).tolist()
    share = counts[counts > 0] / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = text.split("\n")
    return [
        math.log1p(len(data)), math.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(), upper / size, digits / size, marks / size, exclaims / size, spaces / size, beyond / size,
        len(seen) / n, sum(map(operator.eq, words, words[1:])) / n, max(seen.values(), default=0) / n, math.log1p(len(lines)), len(set(lines)) / len(lines), len(words) / (stops + 1), markup / size,
        float(-(share @ np.log2(share))) if len(share) else 0.0, sum(map(str.istitle, words)) / n, brackets / size,
    ]


@dataclass
class Forest:
    """All trees in four arrays: node i tests feature[i] <= threshold[i] and
    goes to left[i], else to left[i] + 1; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.bias)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.feature[node]
                right = x[rows, np.maximum(inner, 0)] > self.threshold[node]
                node = np.where(inner < 0, node, self.left[node] + right)
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts TREES trees on the logistic loss. Splits come from histograms
    of gradients over at most BINS quantile bins a feature. Without rows, or
    with one class alone, the forest is its bias."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}
    roots: list[int] = []
    bias = math.log(mean / (1 - mean))

    def add() -> int:
        for column, start in zip(nodes.values(), (-1, 0.0, 0, 0.0)):
            column.append(start)
        return len(nodes["feature"]) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
        flat = binned + (np.arange(len(cuts)) * BINS)[:, None]
        margin = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            roots.append(add())
            level = [(roots[-1], np.arange(len(y)))]
            for depth in range(DEPTH + 1):
                after = []
                for node, rows in level:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    nodes["value"][node] = RATE * g / (h + RIDGE)
                    if depth == DEPTH or len(rows) < 2 * LEAST:
                        continue
                    at = flat[:, rows].ravel()
                    size = len(cuts) * BINS
                    hist = [np.bincount(at, np.tile(w, len(cuts)), size).reshape(-1, BINS).cumsum(axis=1) for w in (grad[rows], hess[rows], np.ones(len(rows)))]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                    f, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                        continue
                    left = add()
                    add()
                    nodes["feature"][node], nodes["threshold"][node], nodes["left"][node] = int(f), float(cuts[f][b]), left
                    goes = binned[f, rows] <= b
                    after += [(left, rows[goes]), (left + 1, rows[~goes])]
                for node, rows in level:
                    if nodes["feature"][node] < 0:
                        margin[rows] += nodes["value"][node]
                level = after
    return Forest(np.array(nodes["feature"], int), np.array(nodes["threshold"]), np.array(nodes["left"], int), np.array(nodes["value"]), np.array(roots, int), bias)


def train(documents: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fits on about `sample` labelled rows, taken by a hash of the id.

    labels (doc_id, quality); null labels are left out, and so are ids without
    a document. A null text counts as empty. Ids are at most about `sample`,
    so their side of the join is broadcast; of several documents of one id,
    that of the least hash is used, so no more features reach the driver.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("double").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("th"), "text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x or "") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(found, pa.list_(pa.float64())), batch.column("label")], names=["doc_id", "th", "features", "label"])

    measured = texts.mapInArrow(measure, "doc_id long, th long, features array<double>, label double")
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("th", "features", "label")).alias("x")).select("x.features", "x.label").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows.column("label").to_numpy())


def scored(documents: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, text) to (doc_id, score), one row per input row.

    score is from 0 to 1, higher for likelier good texts; null counts as
    empty; repeated rows and null ids are kept; further columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "text", 4 << 20):
            x = np.array([statistics(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column("doc_id"), pa.array(forest.score(x), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out(F.col("doc_id"), 5, 0))
    found = scored(documents, train(documents, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
