"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over the words of a text. For labelled sentences that name a group of people, the
group is swapped for another and for a neutral word, and the model is penalised for every change of score
between the two; the same is done with groups put into sentences that name none. A neutral mention of a
group then cannot raise a score, whatever it stood beside in the labelled texts.

NULL texts count as empty; a text without words has the score of the intercept alone. Equal texts have
equal scores, and the order of words does not matter. An empty table gives no rows. Without labelled rows of both kinds every score is
the share of toxic rows (0 when there are none).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from siteroster.llm.common import add_columns

#: Names of groups that are swapped with each other, by kind; the first of each kind is neutral. The default of ``fit``, which
#: takes any other list, as for other languages.
GROUPS = (
    ("people", "women", "men", "girls", "boys", "elderly", "children"),
    ("person", "woman", "man", "girl", "boy", "child"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("tall", "gay", "lesbian", "straight", "transgender", "queer", "bisexual"),
    ("local", "black", "white", "asian", "african", "american", "european", "mexican", "arab", "indian", "chinese"),
    ("citizens", "immigrants", "refugees", "foreigners", "natives"),
    ("busy", "blind", "deaf", "disabled", "old", "young", "poor", "rich"),
    ("personas", "mujeres", "hombres", "musulmanes", "judíos", "inmigrantes"),
    ("personnes", "femmes", "hommes", "musulmans", "juifs", "immigrés"),
    ("menschen", "frauen", "männer", "muslime", "juden", "einwanderer"),
)
Groups = tuple[tuple[str, ...], ...]
_SENTENCE = re.compile(r"[^.!?\n]+")
_NOT_WORD = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha() and chr(c) != "'"})


def words(text: str) -> set[str]:
    """Distinct words in lower case, without ASCII signs and digits."""
    return set(text.lower().translate(_NOT_WORD).split())


def places(groups: Groups) -> dict[str, tuple[int, int]]:
    """Kind and place of each name."""
    return {term.lower(): (i, j) for i, kind in enumerate(groups) for j, term in enumerate(kind)}


def swapped(terms: set[str], shift: int, groups: Groups = GROUPS) -> set[str]:
    """The words with each group replaced by another of its kind; shift 0 takes the neutral one."""
    place, out = places(groups), set()
    for w in terms:
        if w in place:
            i, j = place[w]
            w = groups[i][0 if shift == 0 else (j + shift) % len(groups[i])].lower()
        out.add(w)
    return out


@dataclass
class ToxicModel:
    weights: dict[str, float]
    intercept: float

    def logit(self, terms: set[str]) -> float:
        get = self.weights.get
        return self.intercept + sum(get(w, 0.0) for w in (self.weights.keys() & terms))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(words(text))))))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[set[str]], index: dict[str, int]):
        cols = [[index[w] for w in r if w in index] for r in rows]
        self.n, self.size = len(rows), len(index)
        self.cols = np.array([c for r in cols for c in sorted(r)], int)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in cols])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.size)


def features(docs: list[set[str]], labels: np.ndarray, names: set[str], most: int = 3000, least: int = 3, evidence: float = 8.0) -> list[str]:
    """Words in at least ``least`` texts that tell the labels apart (log likelihood ratio of ``evidence``
    at least, the ``most`` best), and all ``names`` of groups."""
    toxic = Counter(w for d, y in zip(docs, labels) if y for w in d)
    every = Counter(w for d in docs for w in d)
    n, t = len(docs), int(labels.sum())

    def ratio(w: str) -> float:
        a, b = toxic[w], every[w]
        cells = ((a, b * t / n), (b - a, b * (n - t) / n), (t - a, t * (n - b) / n), (n - b - t + a, (n - b) * (n - t) / n))
        return sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)
    told = sorted((-r, w) for w, c in every.items() if c >= least and w not in names and (r := ratio(w)) >= evidence)
    return sorted(w for _, w in told[:most]) + sorted(names)


def fit(pairs: list[tuple[str, int]], fairness: float = 4.0, sparsity: float = 1e-4, steps: int = 1000,
        toxic_weight: float = 3.0, groups: Groups = GROUPS, made: int = 300) -> ToxicModel:
    """Fit by accelerated proximal gradient: log loss, with toxic rows counted ``toxic_weight`` times,
    + fairness * (change of score)^2 + sparsity * |weights|. Of near copies one is used. ``groups`` are the names to swap,
    by kind, each kind with its neutral name first; ``made`` sentences without a group are given one."""
    pairs = _distinct(pairs)
    docs = [words(t) for t, _ in pairs]
    y = np.array([int(v) for _, v in pairs], float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicModel({}, math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    names = features(docs, y.astype(bool), set(places(groups)))
    index = {w: i for i, w in enumerate(names)}
    before, after = _counterfactuals([t for t, _ in pairs], groups, made)
    x, left, right = _Rows(docs, index), _Rows(before, index), _Rows(after, index)

    # a bound on the curvature from the largest rows and columns of each part
    def bound(r: _Rows) -> float:
        return float(np.bincount(r.rows, minlength=1).max(initial=1) * np.bincount(r.cols, minlength=1).max(initial=1)) ** 0.5
    m = max(1, left.n)
    rate = 1 / (0.25 * (1 + bound(x) ** 2 / len(docs)) + 2 * fairness * (bound(left) + bound(right)) ** 2 / m)
    rate = max(rate, 0.05)
    weight = np.where(y > 0, toxic_weight, 1.0)
    weight /= weight.sum()
    share = float((weight * y).sum())
    w, b = np.zeros(len(names)), math.log(share / (1 - share))
    v, vb, momentum = w.copy(), b, 1.0
    loss = math.inf
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(v) + vb, -30, 30)))
        change = left.dot(v) - right.dot(v)
        slip = (p - y) * weight
        grad = x.back(slip) + 2 * fairness / m * (left.back(change) - right.back(change))
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        new_b = vb - rate * float(slip.sum())
        now = float(-np.sum(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))) + fairness * np.mean(change ** 2 if left.n else 0)
                    + sparsity * np.abs(v).sum())
        if now > loss * 1.0005:  # overshot: start the momentum anew with shorter steps
            rate, momentum, v, vb, loss = rate / 2, 1.0, w.copy(), b, math.inf
            continue
        loss = now
        nxt = (1 + math.sqrt(1 + 4 * momentum ** 2)) / 2
        v, vb = new + (momentum - 1) / nxt * (new - w), new_b + (momentum - 1) / nxt * (new_b - b)
        w, b, momentum = new, new_b, nxt
    return ToxicModel({n: float(c) for n, c in zip(names, w) if c}, float(b))


def _distinct(pairs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One text of those that share their label and the four words of smallest hash, as near copies mostly do.
    Else the words of a text that was copied often would look like signs of its label."""
    kept = {}
    for text, label in pairs:
        key = tuple(sorted(zlib.crc32(w.encode()) for w in words(text))[:4])
        kept.setdefault((key, int(label)), (text, label))
    return list(kept.values())


def _counterfactuals(texts: list[str], groups: Groups, made: int) -> tuple[list[set[str]], list[set[str]]]:
    """Pairs of sentences that differ in the group they name."""
    before, after, plain, place = [], [], [], places(groups)
    for text in texts:
        for s in _SENTENCE.findall(text):
            terms = words(s)
            if terms & place.keys():
                before.append(terms)  # a mention alone is no sign either
                after.append(terms - place.keys())
                for shift in (0, 1, 2):
                    before.append(terms)
                    after.append(swapped(terms, shift, groups))
            elif terms and len(plain) < made:
                plain.append(terms)
    every = sorted(place)
    for i, terms in enumerate(plain if every else []):
        put = terms | {every[i % len(every)]}
        for shift in (0, 1):
            before.append(put)
            after.append(swapped(put, shift, groups))
    return before, after


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Add score, the probability of label 1, and predicted: 1 from 0.5 on."""
    def score(texts):
        values = [model.score(t or "") for t in texts]
        return {"score": values, "predicted": [int(v >= 0.5) for v in values]}
    return add_columns(df, text, "score double, predicted integer", score)
