"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts. Trees are grown level by level on a bounded sample of
labelled rows and kept as flat arrays, so that a batch of documents walks all trees with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches

#: At most so many labelled rows are used to fit, those with the smallest hashed identifiers.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_WEIGHT = 80, 4, 64, 0.15, 1.0, 2.0

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "exclaim": b"!?",
    "pipe": b"|",
    "symbol": b"#$%&*@^~+=<>\\/_",
    "bracket": b"()[]{}\"'",
    "high": bytes(range(128, 256)),
    "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}
STATISTICS = [
    "log_bytes", *(f"share_{k}" for k in _GROUPS), "entropy", "mean_word", "distinct_words", "log_words",
    "mean_line", "distinct_lines", "capital_words", "odd_words", "longest_word", "end_stop",
]


def document_statistics(texts: list[str]) -> np.ndarray:
    """One row of statistics a text; an empty or null text has zeros."""
    masks = np.zeros((256, len(_GROUPS)))
    for k, group in enumerate(_GROUPS.values()):
        masks[list(group), k] = 1
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 10))
    for i, text in enumerate(texts):
        text = text or ""
        raw = text.encode("utf-8", "replace")
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        if not words:
            continue
        distinct = set(words)
        sizes = [len(w) for w in distinct]
        rest[i] = (
            len(text) / len(words), len(distinct) / len(words), np.log1p(len(words)), len(text) / len(lines),
            len(set(lines)) / len(lines), sum(map(str.isupper, distinct)) / len(distinct),
            sum(not w.rstrip(".,;:!?").isalpha() for w in distinct) / len(distinct), min(max(sizes), 100),
            sum(line.rstrip().endswith(".") for line in lines) / len(lines), 0,
        )
    total = counts.sum(1)
    shares = counts / np.maximum(total, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(shares > 0, shares * np.log2(shares), 0).sum(1)
    return np.column_stack([np.log1p(total), shares @ masks, entropy, rest[:, 0], rest[:, 1], rest[:, 2], rest[:, 3], rest[:, 4], rest[:, 5], rest[:, 6], rest[:, 7], rest[:, 8]])


@dataclass
class FlatTrees:
    """Complete trees: node k has children 2k+1 and 2k+2; inner nodes compare, leaves add."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> FlatTrees:
    """Boost logistic loss with trees of fixed depth on binned statistics.

    Without rows the score is 0.5 everywhere; with one class it is that class's prior.
    """
    n, width = x.shape
    inner = 2**depth - 1
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    model = FlatTrees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    cell = binned + np.arange(width) * BINS
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            g, h = (np.bincount(flat, np.repeat(w, width), count * width * BINS).reshape(count, width, BINS).cumsum(2) for w in (grad, hess))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(h < MIN_WEIGHT) | (ht - h < MIN_WEIGHT)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    model.feature[t, first + k], model.threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.threshold[t][node])
        where = node - inner
        g, h = np.bincount(where, grad, inner + 1), np.bincount(where, hess, inner + 1)
        model.leaf[t] = -RATE * g / (h + L2)
        margin += model.leaf[t][where]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the identifier's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAINING_ROWS) -> FlatTrees:
    """Fit on at most ``limit`` labelled documents outside the held-out fold.

    Several labels of one document count as their rounded mean; null labels and labels without a
    document are left out.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    bounded_batches(docs.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "target": batch["target"], "x": list(document_statistics(batch["text"].tolist()))})

    found = rows.mapInPandas(measure, "doc_id long, target int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.vstack(found["x"].tolist()) if len(found) else np.zeros((0, len(STATISTICS)))
    return fit(x, found["target"].to_numpy(np.float64))


def score(docs: DataFrame, model: FlatTrees) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) added, a row for each row; a null text scores as an empty one.

    A column named score is replaced; other columns stay as they are.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(document_statistics(texts.tolist())))

    return docs.withColumn("score", run("text"))


def drop_rejected(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they were."""
    return score(docs.select(F.struct("*").alias("row"), "text"), model).where(F.col("score") >= threshold).select("row.*")
