import random

import duckdb
import numpy as np
import pyarrow as pa
from plain_versions import hits
from pyspark.sql import functions as F

from loomtext.llm import decontamination
from loomtext.llm.decontamination import ONE_IN, WindowIndex, blocks_of, clean, find_hits, pieces_of, report, without
from loomtext.llm.queries import OP5_SQL

DRAW = random.Random(11)
WORDS = ["alpha", "Beta", "gam-ma", "δ", "e5", "Zoë"]


def text(n):
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


ITEMS = {1: text(20), 2: text(13), 10: "gam ma δ", 11: "", 12: None, 3: text(40)}
DOCS = {i: text(DRAW.randint(0, 80)) for i in range(60)}
DOCS |= {100: f"{text(30)} {ITEMS[1]} {text(3)}", 101: ITEMS[3].upper().replace("Δ", "δ"), 102: None, 103: "", 104: text(4000) + " " + ITEMS[2]}


def frames(spark):
    docs = spark.createDataFrame([(k, v, "x") for k, v in DOCS.items()], "doc_id long, text string, n_hit string")
    return docs, spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")


def test_same_as_brute_force(spark):
    docs, items = frames(spark)
    want = hits(DOCS, ITEMS)
    for block in (32 << 20, 600):
        got = {r.doc_id: tuple(r)[1:] for r in report(docs, items, block_bytes=block).collect()}
        assert got == want


def test_repeats_nulls_and_empty_tables(spark):
    docs, items = frames(spark)
    twice = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 50, None).otherwise(F.col("doc_id")))
    assert report(twice, items).count() == report(twice, items, block_bytes=600).count() == 2 * len(DOCS)
    assert report(docs.limit(0), items).count() == 0
    assert report(docs, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_clean(spark):
    docs, items = frames(spark)
    want = hits(DOCS, ITEMS)
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}
    cut = {r.doc_id: r.text for r in clean(docs, items, remove="spans").collect()}
    index = WindowIndex([(str(k), v) for k, v in ITEMS.items()])
    for k, v in DOCS.items():
        n, spans, _ = next(index.scan([v]))
        assert cut[k] == (without(v, spans) if spans else v)
        assert len(next(iter(index.scan([cut[k]])))[1]) == 0 or spans
    assert find_hits(docs, items).filter("size(spans) > 0").count() == sum(v[1] > 0 for v in want.values())


def test_clean_puts_the_hits_of_all_blocks_together(spark):
    items = {k: " ".join(f"i{k}w{j}" for j in range(20)) for k in range(12)}
    # a stretch that goes on from one item into the next, of another block or not
    items |= {100 + k: " ".join(items[k].split()[10:] + items[k + 1].split()[:10]) for k in range(11)}
    spread = " ".join(f"{items[k]} {' '.join(f'f{k}x{j}' for j in range(240))}" for k in range(12))
    docs = {1: spread, 2: "a b c", 3: None, 4: "", 5: " ".join(items[k] for k in range(12)) + " end", 6: "a " * 500 + items[3]}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    blocks = [dict(b.collect()) for b in blocks_of(benchmark, 600, "item_id", "text")]
    assert len(blocks) > 4 and all(sum(len(t) + 64 for t in b.values()) <= 600 or len(b) == 1 for b in blocks)
    n_words, n_hit, *_ = hits(docs, items)[1]
    assert ONE_IN * n_hit >= n_words and not any(hits(docs, b)[1][4] for b in blocks)
    rows = [(k, v, "x", "y") for k, v in docs.items()] * 2 + [(None, spread, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, spans string")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for remove in ("documents", "spans"):
        one, many = clean(df, benchmark, remove=remove), clean(df, benchmark, remove=remove, block_bytes=600)
        assert many.schema == df.schema
        assert order(many.collect()) == order(one.collect())
    want = {k for k, v in hits(docs, items).items() if not v[4]}
    assert want == {2, 3, 4, 6}
    assert [r.doc_id for r in clean(df, benchmark, block_bytes=600).sort("doc_id").collect()] == [2, 2, 3, 3, 4, 4, 6, 6]


def test_items_without_an_id_hit_as_the_sql_says(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    items = [(None, passage), (None, "short one"), (None, None), (1, "other " * 15), (2, passage[:60])]
    docs = [(1, f"x {passage} y"), (2, "A short, one"), (3, "other " * 20 + passage), (4, "nothing"), (5, None)]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sql = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        sql.register(name, pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    want = sorted(sql.sql(OP5_SQL).fetchall())
    assert [r[-1] for r in want] == [True, True, True, False, False]
    for block in (32 << 20, 100):
        assert sorted(map(tuple, report(documents, benchmark, block_bytes=block).collect())) == want
        assert sorted(r.doc_id for r in clean(documents, benchmark, block_bytes=block).collect()) == [4, 5]


def test_the_index_has_a_bounded_size_and_tells_equal_hashes_apart(monkeypatch):
    text = " ".join(f"w{DRAW.randrange(10**6)}" for _ in range(40_000))
    index = WindowIndex([("1", text), ("2", text), (None, "w1 w2")])
    assert index.nbytes < 6 * (2 * len(text)) and next(index.scan([text]))[2] == ["1", "2"]
    # all words look alike: only the comparison of the bytes tells windows apart
    monkeypatch.setattr(decontamination, "_word_hashes", lambda words: np.zeros(len(words), np.uint64))
    items = {k: " ".join(DRAW.choice("abcdef") for _ in range(DRAW.randint(1, 18))) for k in range(40)} | {50: "a b c d e f " * 3}
    docs = {k: " ".join(DRAW.choice("abcdef") for _ in range(60)) + " " + items[k] for k in range(20)}
    index = WindowIndex([(str(k), v) for k, v in items.items()])
    for (k, text), (n, spans, found) in zip(docs.items(), index.scan(list(docs.values())), strict=True):
        want = hits({k: text}, items)[k]
        assert (n, sum(e - b for b, e in spans), len(found)) == want[:3]


def test_long_items_are_cut_into_pieces_that_lose_no_window(spark, monkeypatch):
    words = [f"x{DRAW.randrange(50)}" for _ in range(900)]
    items = [(1, " ".join(words)), (2, " ".join(words[:5])), (3, "?!"), (4, None), (None, " ".join(words[100:113]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = pieces_of(benchmark, 13, "item_id", "text").collect()
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 50)
    cut = pieces_of(benchmark, 13, "item_id", "text").collect()
    grams = lambda rows: sorted({(r.item or "", tuple(w[k : k + min(13, len(w))])) for r in rows for w in [r.text.split()] for k in range(max(1, len(w) - 12))})
    assert len(whole) == 3 and len(cut) == 20 and grams(whole) == grams(cut) and min(len(r.text.split()) for r in cut if r.item == "1") >= 13
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 200])) for k in range(0, 900, 37)], "doc_id long, text string")
    want = {k: v for k, v in hits(dict(docs.collect()), {k: v for k, v in items if k}).items()}
    for block in (32 << 20, 700):
        got = {r.doc_id: tuple(r) for r in report(docs, benchmark.filter("item_id is not null"), block_bytes=block).collect()}
        assert {k: v[1:] for k, v in got.items()} == want
