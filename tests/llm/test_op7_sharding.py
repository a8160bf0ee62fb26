import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm.queries import op7_sharding
from loomtext.llm.sharding import assign_shards, pack, write_shards

SF = "/root/testdata/sf0.01"


def by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out


def test_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op7_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    shards = by_shard(rows)
    assert set(shards) == set(range(24))
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(sizes) < 1.02 * np.mean(sizes) and min(sizes) > 0.98 * np.mean(sizes)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_hot_group_is_split_and_sizes_stay_equal(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text " * 20)).otherwise(F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit(" w"), 90))).alias("text"),
    )
    rows = assign_shards(df).collect()
    sizes = [sum(r["size"] for r in own) for own in by_shard(rows).values()]
    assert len(rows) == 6000 and max(sizes) < 1.02 * np.mean(sizes) and min(sizes) > 0.98 * np.mean(sizes)


@pytest.mark.parametrize("ids", ["7L", "CAST(NULL AS LONG)", "IF(id % 2 = 0, id, NULL)"])
def test_a_hot_group_is_cut_whatever_its_ids(spark, ids):
    texts = {"all": F.lit("same text"), "half": F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), F.col("id")))}
    for text in texts.values():
        rows = assign_shards(spark.range(4800).select(F.expr(ids).alias("doc_id"), text.alias("text"))).collect()
        sizes = [sum(r["size"] for r in own) for own in by_shard(rows).values()]
        assert len(rows) == 4800 and len(sizes) == 24 and max(sizes) < 1.02 * np.mean(sizes) and min(sizes) > 0.98 * np.mean(sizes)
        for own in by_shard(rows).values():
            assert sorted(r.slot for r in own) == list(range(len(own)))


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a", 1)] * 3 + [(None, None, 2), (2, "", 3), (3, "b" * 100000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = assign_shards(df, shards=2).collect()
    assert len(got) == 6
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id in (None, 2)} == {(8, 0)}
    for own in by_shard(got).values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert assign_shards(df.limit(0)).count() == 0


def plain_pack(sizes, shards):
    """The rule by plain loops."""
    totals = [sum(x[j] for x in sizes) / shards or 1e-9 for j in range(3)]
    share = [[x[j] / totals[j] for j in range(3)] for x in sizes]
    left, out = [[1.0] * 3 for _ in range(shards)], [None] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-max(share[k]), k)):
        over = [[share[k][j] - left[b][j] - (0, 0.01, 0.01)[j] for j in range(3)] for b in range(shards)]
        room = [b for b in range(shards) if max(over[b]) <= 1e-12]
        if room:
            best = max(room, key=lambda b: (round(sum(x * y for x, y in zip(left[b], share[k])), 12), -b))
        else:
            best = min(range(shards), key=lambda b: (round(sum(w * max(x, 0) ** 2 for w, x in zip((4, 1, 1), over[b])), 15), b))
        out[k] = best
        left[best] = [x - y for x, y in zip(left[best], share[k])]
    return out


def test_pack_is_the_plain_rule():
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 100, (90, 3)).astype(float)
        assert pack(sizes, 4).tolist() == plain_pack(sizes.tolist(), 4)


def test_no_capacity_is_overrun_while_there_is_room():
    sizes = np.array([[10.0, 1, 1]] * 12 + [[1.0, 10, 1]] * 12 + [[1.0, 1, 10]] * 12)
    own = pack(sizes, 6)
    assert all((sizes[own == k].sum(0) == 24).all() for k in range(6))


@pytest.mark.parametrize("bundles", [256, 12])
def test_assignment_is_that_of_the_plain_rule(spark, bundles):
    """With the production parameter each of these groups is a unit; with fewer bundles small ones share a unit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("g")).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    groups = {}
    for r in docs:
        own = groups.setdefault(r.g, [0, 0, 0])
        for j, x in enumerate((len(r.text.encode()) + 8, words(r.text), 1)):
            own[j] += x
    totals, small = [sum(x[j] for x in groups.values()) for j in range(3)], 24 * bundles
    large = sorted(g for g, x in groups.items() if any(x[j] * small > totals[j] for j in range(3)))
    assert all(24 * max(groups[g][j] / totals[j] for j in range(3)) <= 1 for g in large) and len(large) > 20 and (len(large) < len(groups)) == (bundles < 256)
    unit_of = {g: g % small for g in groups} | {g: small + k for k, g in enumerate(large)}
    units = {}
    for g, x in groups.items():
        own = units.setdefault(unit_of[g], [0, 0, 0])
        for j in range(3):
            own[j] += x[j]
    names = sorted(units)
    shard_of = dict(zip(names, plain_pack([units[u] for u in names], 24)))
    got = {r.doc_id: r.shard for r in assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), bundles=bundles).collect()}
    assert got == {r.doc_id: shard_of[unit_of[r.g]] for r in docs}


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit(1).alias("shard"), F.lit("x").alias("_slot2"))
    assigned = assign_shards(df, shards=3)
    write_shards(df, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text, r._shard, r._slot) for r in back.collect()} == {(r.doc_id, f"t{r.doc_id}", r.shard, r.slot) for r in assigned.collect()}
    assert sorted(x.name for x in (tmp_path / "out").glob("_shard=*")) == ["_shard=0", "_shard=1", "_shard=2"]
