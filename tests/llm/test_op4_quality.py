import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomtext.llm import quality_rules as q
from loomtext.llm.queries import op4_quality_rules

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


@pytest.fixture(scope="module")
def parts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return dict(docs.select("doc_id", "text").collect()), {r.doc_id: r.quality for r in labels.collect()}


def test_query_counts_and_verdict(spark, parts):
    texts, labels = parts
    rows = op4_quality_rules(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r)[1:7] == plain(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.content_share >= q.LEAST_CONTENT)
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([bool(y) == k for y, k in judged]) > 0.97


def test_accuracy_on_held_out_documents(parts):
    texts, labels = parts
    ids = sorted(labels)
    field = q.fit_field([(texts[i], labels[i]) for i in ids[::2]])
    held = [(labels[i], q.Quality(texts[i], field)) for i in ids[1::2]]
    held = [(y, d.kept) for y, d in held if not d.base_failed]
    assert np.mean([bool(y) == k for y, k in held]) > 0.95


def test_viterbi_is_the_best_of_all_sequences():
    draw = random.Random(8)
    for _ in range(60):
        field = q.LineField(np.array([[draw.uniform(-1, 1) for _ in q.FEATURES] for _ in range(2)]), np.array([[draw.uniform(-1, 1) for _ in range(2)] for _ in range(2)]))
        lines = [draw.sample(range(len(q.FEATURES)), 3) for _ in range(draw.randint(1, 7))]

        def score(labels):
            return sum(field.emit[y, f].sum() for y, f in zip(labels, lines)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(lines)), key=score)
        assert tuple(field.decode(lines)) == best


def test_training_raises_the_likelihood_and_handles_one_class():
    draw = random.Random(1)
    docs = [([draw.sample(range(8) if y else range(6, len(q.FEATURES)), 3) for _ in range(5)], y) for y in [0, 1] * 20]
    field = q.train_field(docs, rounds=60)
    assert np.mean([np.mean(np.array(field.decode(x)) == y) for x, y in docs]) > 0.95
    assert q.train_field([(x, 1) for x, _ in docs]).decode(docs[0][0]) == [q.CONTENT] * 5
    assert q.fit_field([]).decode([[0]]) == [q.CONTENT]


def test_rows(spark):
    field = q.fit_field([])
    rows = [(1, "a b c " * 30, 1), (1, "a b c " * 30, 1), (None, None, 2), (2, "", 3), (3, " ".join(f"w{k}" for k in range(60000)), 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = q.judge_documents(df, field).collect()
    assert len(got) == 5 and {r.doc_id for r in got if r.kept} == {3}
    kept = q.keep_good(df, field)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3]
    assert q.judge_documents(df.limit(0), field).count() == 0
    assert q.label_lines(df, field).count() == 5


PROSE = [
    "The morning was quiet and nobody in the village had slept well after the long storm.",
    "Two boats lay on the shingle with their sails torn, while children looked for planks.",
    "By noon most of the roofs were covered again and the baker had lit his oven.",
    "An old man told everyone who would listen that he had seen worse in his youth.",
    "Nobody believed him, of course, yet they gave him bread and a seat near the fire.",
]
TABLE = "alpha | beta | gamma | delta | epsilon"


def test_lines_of_both_kinds_in_one_document_get_both_labels(parts):
    texts, labels = parts
    field = q.fit_field([(texts[i], labels[i]) for i in sorted(labels)])
    found = q.Quality("\n".join([PROSE[0], *(TABLE.replace("a", c) for c in "bcdef"), *PROSE[1:]]), field)
    assert found.labels == [1] + [0] * 5 + [1] * 4 and found.kept
    assert not q.Quality("\n".join([PROSE[0], *(TABLE.replace("a", c) for c in "bcdefghijkl"), PROSE[1]]), field).kept
    mixed = [len(set(d.labels)) for d in (q.Quality(texts[i], field) for i in labels) if len(d.labels) > 1]
    assert mixed.count(2) > 10
    assert (field.move[0, 0] > field.move[0, 1]) and (field.move[1, 1] > field.move[1, 0])


def test_labels_agree_with_the_document(parts):
    draw = random.Random(5)
    for _ in range(200):
        field = q.LineField(np.array([[draw.uniform(-1, 1) for _ in q.FEATURES] for _ in range(2)]), np.array([[draw.uniform(-1, 1) for _ in range(2)] for _ in range(2)]))
        n = draw.randint(1, 9)
        lines, words = [draw.sample(range(len(q.FEATURES)), 3) for _ in range(n)], [draw.randint(1, 20) for _ in range(n)]
        for y in (0, 1):
            got = q.labels_that_agree(field, lines, words, y)
            enough = 2 * sum(w for w, label in zip(words, got) if label) >= sum(words)
            assert enough == bool(y)
            own = field.decode(lines)
            if (2 * sum(w for w, label in zip(words, own) if label) >= sum(words)) == bool(y):
                assert got == own


def test_gradient_is_that_of_the_exact_likelihood(monkeypatch):
    """One step from given weights, against differences of the likelihood by all sequences; sequences of two lines."""
    monkeypatch.setattr(q, "SEQUENCE", 2)
    draw = random.Random(6)
    docs = [([draw.sample(range(len(q.FEATURES)), 2) for _ in range(k)], [draw.randint(0, 1) for _ in range(k)]) for k in (1, 2, 3, 4, 2)]
    docs += [(docs[0][0], [0]), (docs[0][0], [1])]
    start = q.LineField(np.array([[draw.uniform(-1, 1) for _ in q.FEATURES] for _ in range(2)]), np.array([[draw.uniform(-1, 1) for _ in range(2)] for _ in range(2)]))
    kinds = [2 * sum(y) >= len(y) for _, y in docs]

    def likelihood(emit, move):
        total = norm = 0.0
        for (lines, y), kind in zip(docs, kinds):
            weight = 0.5 / (kinds.count(kind) * len(lines))
            norm += weight * len(lines)
            for at in range(0, len(lines), 2):
                part, own = lines[at : at + 2], y[at : at + 2]
                score = lambda labels: sum(emit[v, f].sum() for v, f in zip(labels, part)) + sum(move[a, b] for a, b in zip(labels, labels[1:]))
                total += weight * (score(own) - np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=len(part)))))
        return total / norm

    after = q.train_field(docs, start=start, rounds=1, rate=1.0, ridge=0.0)
    for name, scale in (("emit", len(q.FEATURES)), ("move", 1)):
        for k in np.ndindex(getattr(start, name).shape):
            up = {n: getattr(start, n).copy() for n in ("emit", "move")}
            down = {n: getattr(start, n).copy() for n in ("emit", "move")}
            up[name][k] += 1e-5
            down[name][k] -= 1e-5
            slope = (likelihood(**up) - likelihood(**down)) / 2e-5
            assert abs((getattr(after, name)[k] - getattr(start, name)[k]) / scale - slope) < 1e-6


def test_of_an_id_that_is_there_a_thousand_times_one_row_is_taken(spark):
    from pyspark.sql import functions as F

    from loomtext.llm import toxicity

    docs = spark.range(1200).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(5, 1, 0), (1100, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert q.training_sample(docs, labels) == [("text 0", 1), ("text 1100", 0)]
    assert toxicity.training_sample(docs, labels) == [("text 0", 0), ("text 1100", 1)]
