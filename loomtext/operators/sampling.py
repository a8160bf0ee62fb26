"""Reproducible samples, folds and balancing. Order comes from md5(seed|key), never from a random generator,
so that any engine draws the same rows and the number of partitions doesn't matter. Classes are few and large, so no
task ever holds a whole one (see ``ranking``)."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.ranking import first_by_hash, rank_by_hash, rank_in_order

#: Slots of a class that one task makes at a time when it is drawn anew.
SLOTS = 10_000


def label_seed(seed: int, label: str) -> int:
    """Fixed rule: the base seed plus the label's CRC-32 modulo 100,000."""
    return seed + zlib.crc32(label.encode()) % 100_000


def label_seed_column(seed: int, label: Column) -> Column:
    return F.lit(seed) + F.crc32(label.cast("binary")) % 100_000


def hash_order(seed: int | Column, *keys: str) -> Column:
    head = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", head.cast("string"), *[F.col(k).cast("string") for k in keys]))


def sample_classes(
    df: DataFrame, *, seed: int, keys: Sequence[str], label_col: str, cap: int | None = None, balance: bool = False
) -> DataFrame:
    """Of each class the first rows by hash: as many as the smallest class (``balance``) and ``cap`` allow."""
    if cap is None and not balance:
        return df
    labelled = df.withColumn("_label", F.upper(F.col(label_col).cast("string")))
    most = F.min("_total").over(Window.partitionBy(F.lit(0))) if balance else F.lit(cap)
    if balance and cap is not None:
        most = F.least(most, F.lit(cap))
    hashed = hash_order(label_seed_column(seed, F.col("_label")), *keys)
    return first_by_hash(labelled, ["_label"], hashed, keys, most.cast("long")).drop("_label")


def stratified_folds(df: DataFrame, *, n_splits: int, seed: int | None, keys: Sequence[str], label_col: str) -> DataFrame:
    """``fold`` (from 0): rows of a class, by hash (or by key without a seed), are dealt out in turn where the class
    before it stopped, so that every fold's classes and size differ by one at most."""
    if n_splits <= 1:
        raise ValueError("two folds at least are needed")
    counts = df.groupBy(label_col).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each class alone passes through the unpartitioned window
    starts = counts.select(F.col(label_col).alias("_label"), before.alias("_before"))
    ranked = rank_in_order(df, [label_col], keys) if seed is None else rank_by_hash(df, [label_col], hash_order(seed, *keys), keys)
    joined = ranked.join(starts, F.col(label_col).eqNullSafe(F.col("_label")))
    fold = F.pmod(F.col("_before") + F.col("_rank") - 1, F.lit(n_splits)).cast("int")
    return joined.withColumn("fold", fold).select(*df.columns, "fold")


def train_test_rows(folded: DataFrame, n_splits: int) -> DataFrame:
    """Each row once for each split ``k``, with ``is_test`` where it is in that fold."""
    splits = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    return folded.select("*", splits.alias("k")).withColumn("is_test", F.col("fold") == F.col("k"))


def downsample(train: DataFrame, *, seed: int, keys: Sequence[str], label_col: str, by: Sequence[str] = ("k",)) -> DataFrame:
    """In each split every class is cut to its smallest, by hash of seed + split."""
    split = Window.partitionBy(*(by or [F.lit(0)]))
    # each class has one first cell; a split of one class stays whole
    classes = F.count_if(F.col("_upto") == F.col("_n")).over(split)
    size = F.when(classes < 2, F.col("_total")).otherwise(F.min("_total").over(split))
    return first_by_hash(train, [*by, label_col], hash_order(_split_seed(seed, by), *keys), keys, size)


def upsample(train: DataFrame, *, seed: int, keys: Sequence[str], label_col: str, by: Sequence[str] = ("k",)) -> DataFrame:
    """Smaller classes are redrawn with replacement to the largest one's size; ``slot`` tells copies apart."""
    group = [*by, label_col]
    sizes = train.groupBy(*group).agg(F.count("*").alias("_n"))
    largest = Window.partitionBy(*by)
    sizes = sizes.withColumn("_most", F.max("_n").over(largest)).withColumn("_classes", F.count("*").over(largest))
    # in blocks that are dealt out before their slots are made, as a class is one row here
    last = F.when(F.col("_classes") < 2, F.col("_n")).otherwise(F.col("_most"))
    blocks = sizes.withColumn("_last", last).withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("_last") - 1) / SLOTS).cast("int"))))
    made = F.sequence(F.col("_block") * SLOTS + 1, F.least(F.col("_last").cast("int"), (F.col("_block") + 1) * SLOTS))
    slots = blocks.repartition(*group, "_block").select(*group, "_n", "_most", "_classes", F.explode(made).alias("slot"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", _split_seed(seed, by).cast("string"), F.col(label_col).cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    whole = (F.col("_n") == F.col("_most")) | (F.col("_classes") < 2)
    slots = slots.withColumn("_rank", F.when(whole, F.col("slot")).otherwise(F.pmod(drawn, F.col("_n")) + 1).cast("long"))
    ranked = rank_by_hash(train, group, hash_order(_split_seed(seed, by), *keys), keys)
    return slots.select(*group, "slot", "_rank").join(ranked, [*group, "_rank"]).select(*train.columns, "slot")


def _split_seed(seed: int, by: Sequence[str]) -> Column:
    return F.lit(seed) + (F.col(by[0]).cast("int") if by else F.lit(0))


def balance_train(train: DataFrame, strategy: str, **options) -> DataFrame:
    """``none``, ``downsample`` or ``upsample``."""
    if strategy == "none":
        return train
    if strategy not in ("downsample", "upsample"):
        raise ValueError(f"unknown balancing: {strategy}")
    return (downsample if strategy == "downsample" else upsample)(train, **options)


def balanced_counts(counts: DataFrame, strategy: str, *, label_col: str = "y", by: Sequence[str] = ("k",)) -> DataFrame:
    """(by, label, n) of rows (by, label, n) after balancing: every class has the size of the smallest or largest one."""
    if strategy not in ("none", "downsample", "upsample"):
        raise ValueError(f"unknown balancing: {strategy}")
    if strategy == "none":
        return counts.select(*by, label_col, "n")
    size = (F.min if strategy == "downsample" else F.max)("n").over(Window.partitionBy(*by))
    return counts.select(*by, label_col, size.alias("n"))


def train_test_split(df: DataFrame, *, share: float, seed: int, keys: Sequence[str], label_col: str, least_class: int = 2) -> DataFrame:
    """``is_test`` for round(share * n) rows of each class, by hash; classes must have ``least_class`` rows."""
    sizes = df.groupBy(F.col(label_col).alias("_label")).agg(F.count("*").alias("_n"))
    few = sizes.agg(F.min("_n").alias("n"), F.count("*").alias("classes")).first()
    if few["classes"] < 2 or few["n"] < least_class:
        raise ValueError("two classes with enough rows are needed")
    ranked = rank_by_hash(df, [label_col], hash_order(seed, *keys), keys).join(sizes, F.col(label_col).eqNullSafe(F.col("_label")))
    return ranked.withColumn("is_test", F.col("_rank") <= F.round(F.lit(share) * F.col("_n"))).select(*df.columns, "is_test")
