"""Language identification with a byte convolutional network over fixed-length windows.

Filters of several widths, the largest response of each per window, and a softmax over the languages,
trained in numpy on labelled text. A text is cut into overlapping windows that cover it to its end; the
probabilities of its windows are averaged.

A NULL text, or one without any letter, is ``und`` with score 0. Equal texts get equal answers. Ties take
the language that comes first in order. With no labelled text every text is ``und``. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteroster.llm.bytecnn import Adam, Filters, softmax, windows
from siteroster.llm.common import add_columns
from siteroster.llm.samples import FIT_BYTES, FIT_ROWS

WINDOW, STRIDE = 256, 240
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A character of a letter category; digits and number signs of any script are none."""
    return any(m.group().isalpha() for m in _letter.finditer(text))


class LanguageNet:
    def __init__(self, widths: tuple[int, ...] = (2, 3, 4), per_width: int = 12, seed: int = 5):
        self.filters = Filters(widths, per_width, seed=seed)
        self.languages: list[str] = []
        self.head: dict[str, np.ndarray] = {}
        self.seed = seed

    def fit(self, texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 96, rate: float = 5e-3) -> LanguageNet:
        """Each step draws texts, and of each text one window."""
        self.languages = sorted(set(labels))
        rng = np.random.default_rng(self.seed)
        target = np.array([self.languages.index(x) for x in labels], int)
        self.head = {"w": rng.normal(0, 0.1, (self.filters.count, len(self.languages))).astype(np.float32),
                     "b": np.zeros(len(self.languages), np.float32)}
        if len(self.languages) < 2:
            return self
        adam = Adam(self.filters.params | self.head, rate)
        groups = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        for step in range(steps):
            adam.rate = rate * (1 - step / steps) + rate * 0.05
            # every language alike, however rare
            pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
            begin = [int(rng.integers(0, max(1, len(texts[i]) - WINDOW + 1))) for i in pick]
            rows, _ = windows([texts[i][b:b + WINDOW] for i, b in zip(pick, begin)], WINDOW, STRIDE)
            pooled, at = self.filters.pooled_at(rows)
            d = softmax(pooled @ self.head["w"] + self.head["b"])
            d[np.arange(len(d)), target[pick]] -= 1
            d = (d / len(d)).astype(np.float32)
            grads = self.filters.gradients(rows, pooled, at, d @ self.head["w"].T)
            adam.update(grads | {"w": pooled.T @ d, "b": d.sum(0)})
        return self

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean over all windows of each text."""
        rows, counts = windows(texts, WINDOW, STRIDE)
        p = softmax(self.filters.pooled(rows, 64) @ self.head["w"] + self.head["b"])
        return np.add.reduceat(p, np.cumsum(counts) - counts) / counts[:, None]


def sample(documents: DataFrame, learnable: Column, rows: int = FIT_ROWS, longest: int = FIT_BYTES) -> list[tuple[str, str]]:
    """At most ``rows`` (text, lang) pairs, the same in every run: of each language the ids with the smallest hashes.

    Languages take turns, so that a rare one has a share as well. Ids are chosen before any text is read; NULL ids, texts and
    languages and texts over ``longest`` bytes do not take part. Rows that repeat an id and language may double the number of
    pairs at most.
    """
    fit = learnable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
    order = [F.xxhash64("_id"), F.col("_id")]
    # ranks over ``rows`` are cut before the shuffle, so that a language of most rows sends few
    turn = F.row_number().over(Window.partitionBy("_lang").orderBy(*order))
    ids = (documents.filter(fit).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
           .withColumn("_turn", turn).filter(F.col("_turn") <= rows).orderBy("_turn", *order, "_lang").limit(rows)
           .select("_id", "_lang").dropDuplicates())
    found = (documents.filter(fit & (F.octet_length("text") <= longest)).select("doc_id", "lang", "text")
             .join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
             .orderBy("doc_id", "lang", "text").limit(2 * rows))
    return [(r["text"], r["lang"]) for r in found.select("text", "lang").collect()]


def fit(pairs: list[tuple[str, str]], **options) -> LanguageNet:
    """Train on (text, language) pairs; texts without a letter are left out."""
    pairs = [(t, x) for t, x in pairs if has_letter(t)]
    return LanguageNet().fit([t.encode() for t, _ in pairs], [x for _, x in pairs], **options)


def identify(df: DataFrame, net: LanguageNet, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the probability of that language."""
    def score(texts):
        out_lang, out_score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and net.languages and has_letter(t)]
        if known:
            p = net.probabilities([texts[i].encode() for i in known])
            for i, row in zip(known, p):
                best = int(row.argmax())
                out_lang[i], out_score[i] = net.languages[best], min(1.0, float(row[best]))
        return {"lang_pred": out_lang, "score": out_score}
    return add_columns(df, text, "lang_pred string, score double", score)
