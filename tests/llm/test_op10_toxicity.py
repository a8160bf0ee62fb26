import math
import re

import numpy as np
import pytest

from loomtext.llm import toxicity as t
from loomtext.llm.queries import op10_toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def sample(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return t.training_sample(docs, labels)


def test_held_out_documents(sample):
    chain = t.fit_chain(sample[::2])
    held = sample[1::2]
    p = chain.predict([x for x, _ in held])
    said = p[:, -1] >= chain.threshold
    toxic = np.array([bool(y) for _, y in held])
    bad = {"idiot", "moron", "clown", "worthless", "disgusting", "stupid", "trash", "pathetic", "scum", "loser"}
    shown = np.array([bool(bad & {w.decode() for w in t.alnum_words(x)}) for x, _ in held])
    assert said[toxic & shown].mean() > 0.95
    assert said[~toxic].mean() < 0.01 and said[toxic].mean() > 0.85
    assert chain.names == ["theme_1", "theme_2", "toxic"] and 0.2 < chain.threshold < 0.8


def test_later_links_see_earlier_probabilities(sample):
    chain = t.fit_chain(sample[:400])
    assert [len(w) for w in chain.weights] == [len(chain.words) + k + 1 for k in range(3)]
    text = "you idiot"
    x = chain.features([text])
    want = []
    for w in chain.weights:
        z = x[0] @ w[: len(chain.words)] + np.dot(want, w[len(chain.words) : -1]) + w[-1]
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(chain.predict([text])[0], want)


def plain_probabilities(chain, text):
    """One text through the chain by plain loops."""
    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode()))
    said = words | {b"^" + w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k}
    known = []
    for weights in chain.weights:
        z = weights[-1] + sum(float(weights[k]) for k, w in enumerate(chain.words) if w in said)
        z += sum(p * float(weights[len(chain.words) + k]) for k, p in enumerate(known))
        known.append(1 / (1 + math.exp(-z)))
    return known


def test_query_is_the_plain_chain(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    chain = t.fit_chain(t.training_sample(docs, labels))
    texts = dict(docs.select("doc_id", "text").collect())
    got = op10_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and 0 < sum(r.toxic for r in got) < 200
    for r in got:
        want = plain_probabilities(chain, texts[r.doc_id])
        assert np.allclose(tuple(r)[1:-1], want, atol=1e-9) and r.toxic == (tuple(r)[-2] >= chain.threshold)


def test_threshold_and_themes_by_plain_loops():
    draw = np.random.default_rng(3)
    for _ in range(20):
        p, y = draw.random(40).round(2), (draw.random(40) < 0.4).astype(float)
        values = sorted(set(p.tolist()))
        score = {}
        for a, b in zip(values, values[1:]):
            precision, recall = y[p >= b].mean(), y[p >= b].sum() / y.sum()
            score[(a + b) / 2] = 1.25 * precision * recall / (0.25 * precision + recall) if recall else 0
        good = [c for c, f in score.items() if f >= max(score.values()) - t.AS_GOOD]
        assert abs(abs(t.best_threshold(p, y) - 0.5) - min(abs(c - 0.5) for c in good)) < 1e-12
    assert t.best_threshold(np.array([]), np.array([])) == 0.5
    x = np.array([[1, 1, 0, 0]] * 5 + [[0, 0, 1, 1]] * 7, float)
    own = t.themes_of(x, 2)
    assert len(set(own[:5].tolist())) == len(set(own[5:].tolist())) == 1 and own[0] != own[-1]


def test_rows(spark):
    words = [f"w{k}" for k in range(1000)]
    chain = t.fit_chain([(" ".join(words[9 * k : 9 * k + 9]) + (" idiot" if k % 2 else ""), k % 2) for k in range(100)])
    rows = [(1, "Idiot! " * 9000, 1), (1, "fine", 2), (None, None, 3), (2, "", 4), (2, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = t.score_documents(df, chain).collect()
    assert len(found) == 5 and sum(r.toxic for r in found) == 1
    assert t.score_documents(df.limit(0), chain).count() == 0
    assert not t.fit_chain([]).predict(["a"])[0, -1] >= 0.5
