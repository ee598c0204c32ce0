"""Quality by gradient-boosted trees over document statistics.

Statistics are binned once into quantile bins, trees are grown level by level on histograms
of gradients, and the grown forest is flattened into arrays (statistic, threshold and
value by tree and node, nodes numbered as in a heap), so that a batch of texts descends all trees
by array look-ups. Learning uses a bounded sample of the labelled rows; every text is
measured and scored in full.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm.common import in_bucket, table

#: Labelled rows that are learned from, in expectation; rows are drawn by a hash of doc_id.
SAMPLE = 20_000
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
#: Weight of the squared leaf values, and the least sum of second derivatives of a leaf.
RIDGE = 1.0
LEAST_HESSIAN = 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars log_words log_lines word_length spaces upper lower digits symbols pipes bangs stops commas others "
    "distinct_words top_word same_next distinct_pairs distinct_lines line_length longest_word capital_words sentence_length"
).split()
_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _STOP, _COMMA, _OTHER = range(10)
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.full(0x10000, _OTHER, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            kind[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            kind[i] = _DIGIT
        elif c.isspace():
            kind[i] = _SPACE
    for chars, k in (("#*$%&<>@^~=_{}[]\\/+", _SYMBOL), ("|", _PIPE), ("!", _BANG), (".?:;", _STOP), (",", _COMMA)):
        kind[[ord(c) for c in chars]] = k
    return kind


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of the whole text; a null text counts as empty."""
    text = text or ""
    kinds = np.zeros(10, np.int64)
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds += np.bincount(_classes()[np.minimum(code, 0xFFFF)], minlength=10)
    found, lines = text.split(), text.split("\n")
    chars, n, n_lines = max(1, len(text)), max(1, len(found)), max(1, len(lines))
    counted = Counter(found)
    lengths = list(map(len, found))
    shares = kinds / chars
    return np.array(
        [
            np.log1p(len(text)),
            np.log1p(len(found)),
            np.log1p(len(lines)),
            sum(lengths) / n,
            *shares,
            len(counted) / n,
            max(counted.values(), default=0) / n,
            sum(map(operator.eq, found, found[1:])) / n,
            len(set(zip(found, found[1:], strict=False))) / max(1, len(found) - 1),
            len(set(lines)) / n_lines,
            len(text) / n_lines,
            max(lengths, default=0),
            sum(map(str.istitle, found)) / n,
            n / (1 + kinds[_STOP]),
        ],
        dtype=np.float64,
    )


@dataclass(frozen=True)
class Forest:
    """Flattened trees: feature and threshold by [tree, inner node], value by [tree, leaf]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        raw, every = np.full(len(rows), self.base), np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            raw += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-raw))


def grow(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosts TREES trees of depth DEPTH on the logistic loss; without rows, a forest that scores 0.5."""
    inner, leaves, n_features = 2**DEPTH - 1, 2**DEPTH, rows.shape[1]
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    value = np.zeros((TREES, leaves))
    if not len(rows):
        return Forest(0.0, feature, threshold, value)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(rows), base)
    offsets = np.arange(n_features) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = labels - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(rows), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            slot = ((node - first)[:, None] * (n_features * BINS) + offsets + binned).ravel()
            size = width * n_features * BINS
            g = np.bincount(slot, np.repeat(gradient, n_features), size).reshape(width, n_features, BINS).cumsum(axis=2)
            h = np.bincount(slot, np.repeat(hessian, n_features), size).reshape(width, n_features, BINS).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = -np.inf
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, leaves)
        h = np.bincount(leaf, hessian, leaves)
        value[t] = RATE * g / (h + RIDGE)
        raw += value[t, leaf]
    return Forest(base, feature, threshold, value)


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Learns quality from the labelled rows that are not held out.

    Repeated labels of a document count once, by the majority, a draw as 1.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_bucket(F.col("doc_id"), 5, 0))
    one = usable.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    n = one.count()
    drawn = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))
    sample = one.where(drawn).select(F.col("doc_id").alias("of"), F.col("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column(0), "quality": batch.column(1), "row": pa.array([r.tobytes() for r in rows], pa.binary())}
            )

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of"))
    picked = picked.select(F.xxhash64("doc_id", "text").alias("key"), "quality", "text")
    got = sorted(picked.mapInArrow(run, "key long, quality int, row binary").collect(), key=lambda r: (r["key"], r["quality"]))
    rows = np.stack([np.frombuffer(r["row"]) for r in got]) if got else np.zeros((0, len(FEATURES)))
    return grow(rows, np.array([r["quality"] for r in got], dtype=np.float64))


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    A null text is scored as an empty one; a null doc_id is not held out; only doc_id and
    text are looked at. If there was nothing to learn from, every score is 0.5.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(forest.score(np.stack([statistics(t.as_py()) for t in texts])))

    found = docs.select("doc_id", in_bucket(F.col("doc_id"), 5, 0).alias("held_out"), score(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
