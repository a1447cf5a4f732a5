"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

Learned filters respond to each chunk and keep their largest response per chunk. The responses of all
chunks are combined by their maximum and mean into one feature vector, and a small hidden layer turns
that into one probability. Training and scoring are numpy; scoring runs in Arrow batches.

NULL texts count as empty; an empty text is one chunk of padding and has a score like any other. Equal
texts have equal scores. An empty table gives no rows. Without labelled rows of both kinds every score is the share of good rows (0.5
when there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siteroster.llm.bytecnn import Adam, Filters, sigmoid, windows
from siteroster.llm.common import add_columns, runs

CHUNK, STRIDE = 512, 448


class QualityNet:
    """Filters, and a head over (maximum, mean) of the chunks of a document."""

    def __init__(self, per_width: int = 12, widths: tuple[int, ...] = (3, 5), hidden: int = 16, seed: int = 1):
        self.filters = Filters(widths, per_width, seed=seed)
        rng, size = np.random.default_rng(seed + 1), 2 * self.filters.count
        self.head = {"w1": rng.normal(0, size ** -0.5, (size, hidden)).astype(np.float32), "b1": np.zeros(hidden, np.float32),
                     "w2": rng.normal(0, hidden ** -0.5, hidden).astype(np.float32), "b2": np.zeros(1, np.float32)}
        self.constant: float | None = None

    @staticmethod
    def combine(pooled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        most = np.maximum.reduceat(pooled, starts)
        mean = np.add.reduceat(pooled, starts) / counts[:, None]
        return np.concatenate([most, mean], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        rows, counts = windows(texts, CHUNK, STRIDE)
        z = self.combine(self.filters.pooled(rows), counts)
        return sigmoid(np.tanh(z @ self.head["w1"] + self.head["b1"]) @ self.head["w2"] + self.head["b2"]).astype(float)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 4e-3,
            most_chunks: int = 16, least_steps: int = 500, seed: int = 3) -> QualityNet:
        """Train on whole labelled texts, as many of each label in a step, so that the rarer one is learned too.

        Of a text with more chunks than ``most_chunks``, each step draws others. Few texts are gone over until there were
        ``least_steps`` steps.
        """
        labels = np.asarray(labels, np.float32)
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        adam = Adam(self.filters.params | self.head, rate)
        steps = max(epochs * -(-len(texts) // batch), least_steps)
        kinds = [np.flatnonzero(labels == k) for k in (0, 1)]
        order = [np.zeros(0, int), np.zeros(0, int)]
        for done in range(steps):
            pick = []
            for k, rows in enumerate(kinds):
                while len(order[k]) < batch // 2:
                    order[k] = np.concatenate([order[k], rng.permutation(rows)])
                pick += order[k][:batch // 2].tolist()
                order[k] = order[k][batch // 2:]
            adam.rate = rate * (1 - done / steps) + rate * 0.05
            self._step(adam, [texts[i] for i in pick], labels[pick], rng, most_chunks)
        return self

    def _step(self, adam: Adam, texts: list[bytes], y: np.ndarray, rng: np.random.Generator, most: int) -> None:
        rows, counts = windows(texts, CHUNK, STRIDE)
        owner = np.repeat(np.arange(len(texts)), counts)
        draw = np.lexsort((rng.random(len(rows)), owner))
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows, owner = rows[draw][nth < most], owner[nth < most]
        counts = np.minimum(counts, most)
        pooled, at = self.filters.pooled_at(rows)
        z, h = self.combine(pooled, counts), self.head
        a = np.tanh(z @ h["w1"] + h["b1"])
        d_logit = ((sigmoid(a @ h["w2"] + h["b2"]) - y) / len(y)).astype(np.float32)
        d_a = d_logit[:, None] * h["w2"] * (1 - a * a)
        d_z = d_a @ h["w1"].T
        f = self.filters.count
        top = pooled == z[owner, :f]
        up = d_z[owner, :f] * top + d_z[owner, f:] / counts[owner][:, None]
        grads = self.filters.gradients(rows, pooled, at, up)
        grads |= {"w1": z.T @ d_a, "b1": d_a.sum(0), "w2": a.T @ d_logit, "b2": d_logit.sum(keepdims=True)}
        adam.update(grads)


def fit(pairs: list[tuple[str, int]], **options) -> QualityNet:
    """Train on (text, quality) pairs."""
    return QualityNet().fit([t.encode() for t, _ in pairs], np.array([int(q) for _, q in pairs]), **options)


def score_quality(df: DataFrame, net: QualityNet, text: str = "text") -> DataFrame:
    """Add score, the probability of label 1, and predicted: 1 from 0.5 on."""
    def score(texts):
        values = net.scores([(t or "").encode() for t in texts])
        return {"score": values, "predicted": (values >= 0.5).astype(np.int32)}
    return add_columns(df, text, "score double, predicted integer", score)


def keep_good(df: DataFrame, net: QualityNet, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, at):
                values = net.scores([(t or "").encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(values >= least))
    return df.mapInArrow(work, df.schema)
