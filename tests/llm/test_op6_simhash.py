import random

import xxhash
from plain_versions import components

from loomtext.llm.components import connected_components
from loomtext.llm.queries import op6_simhash
from loomtext.llm.simhash import close_links, fingerprint, keep_one, near_duplicates

SF = "/root/testdata/sf0.01"


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_is_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = {k: plain(t) for k, t in texts.items()}
    want = components([(k, v) for k, v in prints.items()])
    got = op6_simhash(spark, SF).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in texts}
    assert len(set(want.values())) < len(want)


def test_crowded_buckets_lose_no_link(spark):
    draw = random.Random(2)
    center = draw.getrandbits(64)
    prints = {0, center, (1 << 64) - 1}
    for _ in range(400):
        value = center
        for _ in range(draw.randint(0, 5)):
            value ^= 1 << draw.randint(0, 63)
        prints.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    want = components([(v, v) for v in signed])
    for crowded in (2, 16, 1000):
        df = spark.createDataFrame([(v,) for v in signed], "fp long")
        got = {r.node: r.root for r in connected_components(close_links(df, crowded)).collect()}
        assert {v: got.get(v, v) for v in signed} == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(1, 300)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 301)} | {500: 500, 501: 500}


def test_rows(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (2, "A B C D", 2), (None, "", 3), (9, None, 4), (4, "x y " * 20000, 5), (None, "p q r s t", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = near_duplicates(df).collect()
    assert len(got) == 7
    assert {r.component_id for r in got if r.doc_id in (5, 2)} == {2}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {9}
    assert near_duplicates(df.limit(0)).count() == 0
    kept = keep_one(df)
    # the empty text without an id goes with row 9, the other row without an id is alone
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[:2] == [(0, "p q r s t"), (2, "A B C D")]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 9]
    assert fingerprint("a") == xxhash.xxh64_intdigest(b"a", 42)


def test_keep_one_with_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [
        (5, text("a"), 1), (5, text("b"), 2), (5, text("b"), 2), (5, text("c"), 3), (7, text("c").upper(), 4),
        (None, text("a"), 5), (None, text("d"), 6), (None, text("d").upper(), 7), (8, text("e"), 8), (3, text("e").upper(), 9), (3, text("f"), 10),
        (9, text("g").upper(), 11), (9, text("g"), 12), (10, text("h"), 13), (9, text("h").upper(), 14),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.k for r in kept.collect())
    # one of the equal rows 2; 14 has the smaller number, if not the smaller text; 5 goes with row 1's component; of 6 and
    # 7, without any id, and of 11 and 12, with one id, one stays
    assert [k for k in got if k not in (6, 7, 11, 12)] == [1, 2, 3, 9, 10, 14]
    assert len({6, 7} & set(got)) == len({11, 12} & set(got)) == 1
    assert sorted(r.k for r in keep_one(df.repartition(7)).collect()) == got
