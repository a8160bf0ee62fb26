"""Toxicity by a classifier chain: categories one after another, each seeing the probabilities of those before.

Each link is a logistic model over the presence of words and word beginnings and the earlier categories' probabilities; while it is trained
these are out-of-fold predictions, so that no link learns from probabilities that have seen their own row.

No word is given. The labels have one kind of toxicity, so the categories before it are themes found in the sample:
the toxic documents, divided by the words that tell them from clean ones. The last link's threshold is the one that
does best on the sample's out-of-fold predictions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import alnum_words, id_type, map_texts

#: Labelled documents of each label that the chain is trained on, at most, and words that it may weigh: those with the
#: highest chi-squared.
TRAINING_DOCUMENTS, VOCABULARY = 1500, 1000
FOLDS, THEMES, AS_GOOD = 5, 2, 0.02
#: Documents of the sample in which a word must stand to be weighed, and its least chi-squared (chance: one in 30,000).
LEAST_DOCUMENTS, LEAST_CHI_SQUARED = 5, 17.4
FINAL = "toxic"


#: Lengths in bytes of the word beginnings that are features too; inflected and compound words share them.
BEGINNINGS = (4, 5, 6, 7)


def features_of(text: str | None) -> set[bytes]:
    """Words of a text, and beginnings of its words marked by ``^``."""
    words = set(alnum_words(text))
    return words | {b"^" + w[:k] for k in BEGINNINGS for w in words if len(w) > k}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights, the last of them the constant, by Newton's method with a ridge; one class alone gives its constant."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    if len(set(y.tolist())) < 2:
        w[-1] = 10.0 if len(y) and y[0] else -10.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        step = np.linalg.solve((x1.T * (p * (1 - p) + 1e-9)) @ x1 + np.diag(penalty), x1.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def themes_of(x: np.ndarray, themes: int, rounds: int = 20) -> np.ndarray:
    """A number for each row: k-means, begun with equal parts of the rows by their first principal component."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), int)
    centred = x - x.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    own = np.argsort(np.argsort(-(centred @ axis), kind="stable"), kind="stable") * themes // len(x)
    for _ in range(rounds):
        middles = np.array([x[own == k].mean(0) if (own == k).any() else np.full(x.shape[1], np.inf) for k in range(themes)])
        new = ((x[:, None, :] - middles[None]) ** 2).sum(2).argmin(1)
        if (new == own).all():
            break
        own = new
    return own


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """A threshold halfway between two probabilities: of those whose F score (precision counts twice, as clean
    documents are to be left alone) is within AS_GOOD of the highest, the one nearest to a half."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    cuts = np.flatnonzero(np.diff(p) < 0)
    if not y.any() or not len(cuts):
        return 0.5
    score = 1.25 * np.cumsum(y)[cuts] / (cuts + 1 + 0.25 * y.sum())
    middle = (p[cuts] + p[cuts + 1]) / 2
    best = np.flatnonzero(score >= score.max() - AS_GOOD)
    return float(middle[best[np.abs(middle[best] - 0.5).argmin()]])


class Chain:
    """The words weighed, and a weight vector for each category: words, earlier probabilities, constant."""

    def __init__(self, words: list[bytes], names: list[str], weights: list[np.ndarray], threshold: float = 0.5):
        self.words, self.names, self.weights, self.threshold = words, names, weights, threshold
        self.at = {w: k for k, w in enumerate(words)}
        self.known = frozenset(self.at)

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        for k, text in enumerate(texts):
            for word in self.known.intersection(features_of(text)):
                x[k, self.at[word]] = 1
        return x

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A column of probabilities for each category, in order."""
        x = self.features(texts)
        earlier = np.zeros((len(texts), 0))
        for w in self.weights:
            p = _sigmoid(np.hstack([x, earlier]) @ w[:-1] + w[-1])
            earlier = np.hstack([earlier, p[:, None]])
        return earlier


def without_copies(sample: list[tuple[str | None, int]], alike: float = 0.5, hashes: int = 8) -> list[tuple[str | None, int]]:
    """The sample without texts whose words are mostly those of an earlier one: a label counts once, not for every copy."""
    met: dict[tuple[int, int], list[frozenset]] = {}
    out = []
    for text, y in sample:
        bag = frozenset(alnum_words(text))
        keys = [(k, min((xxhash.xxh3_64_intdigest(w, k) for w in bag), default=0)) for k in range(hashes)]
        if any(2 * len(bag & other) >= alike * (len(bag) + len(other)) for key in keys for other in met.get(key, ())):
            continue
        out.append((text, y))
        for key in keys:
            met.setdefault(key, []).append(bag)
    return out


def fit_chain(sample: list[tuple[str | None, int]], *, themes: int = THEMES, vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
    """The chain of the themes and then FINAL. Words are chosen by chi-squared with the final label."""
    sample = without_copies(sample)
    toxic = np.array([y for _, y in sample], float)
    bags = [features_of(t) for t, _ in sample]
    in_toxic, in_clean = Counter(), Counter()
    for bag, y in zip(bags, toxic, strict=True):
        (in_toxic if y else in_clean).update(bag)
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())

    def chi_squared(word: bytes) -> float:
        a, b = in_toxic[word], in_clean[word]
        c, d = n_toxic - a, n_clean - b
        return (a * d - b * c) ** 2 * (a + b + c + d) / max((a + b) * (c + d) * (a + c) * (b + d), 1)

    usable = [w for w in {*in_toxic, *in_clean} if in_toxic[w] + in_clean[w] >= LEAST_DOCUMENTS]
    rated = sorted((-chi_squared(w), w) for w in usable)
    words = [w for score, w in rated if -score >= LEAST_CHI_SQUARED][:vocabulary]
    names = [*(f"theme_{k + 1}" for k in range(themes)), FINAL]
    chain = Chain(words, names, [])
    x = chain.features([t for t, _ in sample])
    telling = [k for k, w in enumerate(words) if in_toxic[w] * n_clean > in_clean[w] * n_toxic]
    theme = np.full(len(sample), -1)
    theme[toxic > 0] = themes_of(x[toxic > 0][:, telling], themes)
    fold = np.arange(len(sample)) % folds
    earlier = np.zeros((len(sample), 0))
    for k, name in enumerate(names):
        y = toxic if name == FINAL else (theme == k).astype(float)
        own = np.hstack([x, earlier])
        chain.weights.append(fit_logistic(own, y))
        unseen = np.zeros(len(sample))
        for held in range(folds):
            if (fold == held).any():
                w = fit_logistic(own[fold != held], y[fold != held])
                unseen[fold == held] = _sigmoid(own[fold == held] @ w[:-1] + w[-1])
        earlier = np.hstack([earlier, unseen[:, None]])
    chain.threshold = best_threshold(earlier[:, -1], toxic)
    return chain


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS) -> list[tuple[str | None, int]]:
    """(text, toxic) of up to ``limit`` labelled documents of each label, those whose ids come first by hash."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = [rows.filter(F.col("y") == y).orderBy(order, "doc_id").limit(limit) for y in (0, 1)]
    ids = {r.doc_id: r.y for part in chosen for r in part.collect()}
    # of rows that share an id one stands for all, so that what is collected keeps its bound
    found = docs.filter(F.col("doc_id").isin(list(ids))).groupBy("doc_id").agg(F.min("text").alias("text")).collect() if ids else []
    return [(r.text, ids[r.doc_id]) for r in sorted(found, key=lambda r: (r.doc_id, r.text or ""))]


def score_documents(df: DataFrame, chain: Chain, *, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, p_<category> for each category in order, toxic (the last one at the threshold,
    the chain's own unless said).

    Null and empty texts are scored by the constants; ids may be null or repeated; other columns are not looked
    at; an empty table gives an empty one. Whole texts are read, and a word counts once, so length doesn't matter.
    """
    columns = ", ".join(f"p_{name} double" for name in chain.names)
    threshold = chain.threshold if threshold is None else threshold

    def prepare() -> Callable[[list, list], list]:
        def work(ids: list, texts: list) -> list:
            p = chain.predict(texts)
            return [ids, *[c.tolist() for c in p.T], (p[:, -1] >= threshold).tolist()]

        return work

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, {columns}, toxic boolean", prepare, id_col, text_col)
