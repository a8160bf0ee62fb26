"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. A group that has more than one in ``shards * bundles`` of all bytes, tokens or rows is placed
by itself (in pieces, if it is more than a shard holds). Smaller ones, whose sizes don't matter one by one, are dealt by
their hash into so many bundles, and a bundle is placed as a whole: its sums are those of its groups, exactly. A unit
goes where the dot product of its sizes with what is left of a shard's three capacities is highest. Only the units'
sums ever reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import durable

SHARDS = 24
#: Bundles of small groups for each shard; also bounds the number of large groups.
BUNDLES = 256
#: Rows are numbered by cells; no cell of a large group has much more than this part of a shard.
PART_OF_SHARD = 1 / 64
#: Pieces for each shard that a group larger than a shard would fill.
PIECES = 16
#: Bytes that every row counts besides its text; a fixed value of the contract.
ROW_BYTES = 8
#: By how much of its equal part a shard may be over, for bytes, tokens and rows; and how much being over it further
#: counts where no shard has room. Bytes come first, as the law is theirs.
HEADROOM, OVERRUN = np.array([0.0, 0.01, 0.01]), np.array([4.0, 1.0, 1.0])


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. ``sizes``: a row (bytes, tokens, rows) for each item.

    Largest first; among the shards with room for its bytes, tokens and rows, the one with the highest dot product of
    the item with what is left; if none has room, the one that it would take over its room least (squares, weighted by
    OVERRUN). The first among equals.
    """
    capacity = np.maximum(sizes.sum(0) / shards, 1e-9)
    share = sizes / capacity
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int64)
    for k in np.lexsort((np.arange(len(sizes)), -share.max(1))):
        over = share[k] - left - HEADROOM
        fits = (over <= 1e-12).all(1)
        if fits.any():
            to = int(np.argmax(np.where(fits, left @ share[k], -np.inf)))
        else:
            to = int(np.argmin((np.maximum(over, 0) ** 2 * OVERRUN).sum(1)))
        out[k] = to
        left[to] -= share[k]
    return out


def assign_shards(
    df: DataFrame, *, shards: int = SHARDS, bundles: int = BUNDLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Size is the text's UTF-8 bytes plus ``ROW_BYTES``; a null text counts as an empty one. Rows with equal texts stay
    together unless they are more than a shard's equal part; then they are cut by the number that each row gets when it is
    read, so it doesn't matter whether their ids are null or repeated, and another partitioning of ``df`` cuts elsewhere. Slots of a shard follow its bundles and then the ids
    (nulls first, repeated rows in any order). Other columns are not looked at; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = durable(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("g"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")]
    total = slim.agg(*sums).first()
    small = shards * bundles
    # at most 3 * small groups can exceed 1/small of a total
    large = F.lit(False)
    for name in ("size", "tokens", "rows"):
        if total[name]:
            large = large | (F.col(name) * F.lit(small) > F.lit(total[name]))
    groups = slim.groupBy("g").agg(*sums).filter(large & (F.col("rows") * F.lit(small) > 0)).collect()
    groups.sort(key=lambda r: r["g"])
    table, following, bundle_of = [], small, {}
    for row in groups:
        share = max(row[n] * shards / total[n] for n in ("size", "tokens", "rows") if total[n])
        pieces = 1 if share <= 1 else min(row["rows"], math.ceil(PIECES * share))
        cells = max(pieces, min(row["rows"], math.ceil(share / PART_OF_SHARD)))
        bundle_of |= {following + k: following + k * pieces // cells for k in range(cells)}
        table.append((row["g"], following, cells))
        following += cells
    spark = df.sparkSession
    large_groups = spark.createDataFrame(table, "g long, first long, cells long")
    own_cell = F.col("first") + F.pmod(F.xxhash64("at"), F.col("cells"))
    dealt = slim.join(F.broadcast(large_groups), "g", "left").select(
        "id", "size", "crc", "tokens", F.coalesce(own_cell, F.pmod(F.col("g"), F.lit(small))).alias("cell")
    )
    cells = sorted(dealt.groupBy("cell").agg(*sums).collect(), key=lambda r: r["cell"])
    sized: dict[int, np.ndarray] = {}
    for row in cells:
        bundle = bundle_of.get(row["cell"], row["cell"])
        sized[bundle] = sized.get(bundle, 0) + np.array([row["size"], row["tokens"], row["rows"]], float)
    to = dict(zip(sized, pack(np.array(list(sized.values())).reshape(-1, 3), shards).tolist(), strict=True))
    offsets, placed = [0] * shards, []
    for row in cells:
        shard = to[bundle_of.get(row["cell"], row["cell"])]
        placed.append((row["cell"], shard, offsets[shard]))
        offsets[shard] += row["rows"]
    placed = spark.createDataFrame(placed, "cell long, shard int, before long")
    order = Window.partitionBy("cell").orderBy("id", "crc", "size")
    numbered = dealt.withColumn("n", F.row_number().over(order)).join(F.broadcast(placed), "cell")
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("before") + F.col("n") - 1).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """The rows of ``df`` as Parquet, a folder for each shard; ids must be unique here."""
    rows = df.join(assigned.select(id_col, F.col("shard").alias("_shard"), F.col("slot").alias("_slot")), id_col)
    rows.write.mode("overwrite").partitionBy("_shard").parquet(path)
