"""Places of rows in an order, without drawing a group's rows into one task and without Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import durable

#: Hexadecimal digits of the hash that tell a group's cells apart: 4096 cells of about equal size.
CELL_DIGITS = 3
_INSIDE = (1 << 33) - 1  # the part of a monotonically increasing id that counts within its partition


def rank_by_hash(df: DataFrame, by: Sequence[str], hashed: Column, ties: Sequence[str], name: str = "_rank") -> DataFrame:
    """``df`` with the row's place (from 1) among the rows of its group, ordered by a hexadecimal hash and then ``ties``.

    The hash's first digits deal each group out into cells; a row's place is that in its cell plus the sizes of the
    cells before. Only the cells' sizes pass through a window by group. Null group values are a group.
    """
    rows = df.withColumn("_hash", hashed).withColumn("_cell", F.substring("_hash", 1, CELL_DIGITS))
    cell = [*by, "_cell"]
    order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(cell)], F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*cell).orderBy("_hash", *ties)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(cell)]
    return inside.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """``df`` with the row's place (from 0, long) in the whole order: sorted ranges, their sizes, places within.

    The sorted ranges are written to the checkpoint folder, as a second sampling could draw other borders.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = durable(rows)
    part = F.shiftright("_at", 33)
    # a row for each partition alone passes through the unpartitioned window
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    found = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_INSIDE))).cast("long").alias(name))


def rank_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """The row's place (from 1) among the rows of its group in ``order``: its number in all minus its group's first."""
    rows = numbered(df, [*by, *order], "_number")
    first = rows.groupBy(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)]).agg(F.min("_number").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(by)]
    found = rows.join(first, same) if by else rows.crossJoin(first)
    return found.select(*df.columns, (F.col("_number") - F.col("_first") + 1).cast("long").alias(name))


def first_by_hash(df: DataFrame, by: Sequence[str], hashed: Column, ties: Sequence[str], most: Column) -> DataFrame:
    """The rows of each group that ``rank_by_hash`` would place up to ``most``, without ranking the others.

    ``most`` is an expression over a table of cells: the columns ``by``, ``_total`` (rows of the group) and windows over
    them. A histogram of the hashes' first digits tells in which cell the last wanted row of a group falls. Rows of cells
    before it stay and those after it go as they are read; only the rows of that one cell are shuffled and ranked. So
    ``df`` is read three times: who computes it from far makes it durable first.
    """
    keyed = df.withColumn("_hash", hashed)
    cell = F.substring("_hash", 1, CELL_DIGITS)
    group = Window.partitionBy(*by)
    cells = keyed.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_upto", F.sum("_n").over(group.orderBy("_cell"))).withColumn("_total", F.sum("_n").over(group)).withColumn("_most", most)
    # hashes are hexadecimal, so a group without a cut has one after all its cells
    cut = F.when(F.col("_upto") >= F.col("_most"), F.struct(F.col("_cell").alias("at"), (F.col("_most") - F.col("_upto") + F.col("_n")).alias("left")))
    whole = F.struct(F.lit("g").alias("at"), F.lit(0).cast("long").alias("left"))
    cuts = cells.groupBy(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)]).agg(F.coalesce(F.min(cut), whole).alias("_cut"))
    found = keyed.join(cuts, [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(by)])
    before = found.filter(cell < F.col("_cut.at")).select(*df.columns)
    inside = found.filter(cell == F.col("_cut.at")).withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", *ties)))
    return before.unionByName(inside.filter(F.col("_at") <= F.col("_cut.left")).select(*df.columns))
