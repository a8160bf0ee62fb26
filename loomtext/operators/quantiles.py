"""Exact quantiles of classes of any size: sketches cut around a rank, counts decide between the cuts, and only that part goes on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import durable

#: Size of sketches, and values that they are asked for, evenly spaced by rank: as far apart as some three standard errors.
SKETCH, STEPS = 4096, 512
#: Values of a part that one task sorts, at most.
FEW = 10_000
#: Rows of a small table (a few for each class) up to which it is sent to all tasks.
MOST_SENT = 200_000


def sent(small: DataFrame) -> DataFrame:
    """To be joined by a broadcast if it has few rows, which is counted; else as Spark sees fit."""
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def exact_quantiles(values: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, n_rows, mean, quantiles) of ``values`` (by, _v): a linear quantile between two ranks for each share, in order.

    Values that are null or not finite are left out, and so are rows with a null in ``by``. No task holds a class: what is
    shuffled are sketches, counts and parts of FEW values at most. ``values`` are read twice for each step, of which
    each leaves a few thousandths of a class, so who computes them from far makes them durable first.
    """
    values = values.filter(F.abs("_v") < F.lit(float("inf"))).dropna(subset=list(by))
    sizes = durable(values.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg("_v").alias("mean")))
    each = sizes.select(*by, "n_rows", F.posexplode(F.array(*map(F.lit, shares))).alias("_k", "_share"))
    each = each.withColumn("_place", F.col("_share") * (F.col("n_rows") - 1))
    ranks = each.select(*by, "n_rows", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_at")).distinct()
    found = ranked_values(values, by, ranks)
    lower, upper = (found.select(*by, F.col("_at").alias(f"_{n}"), F.col("_v").alias(f"_{n}_v")) for n in ("lower", "upper"))
    both = each.withColumn("_lower", F.floor("_place")).withColumn("_upper", F.ceil("_place")).join(lower, [*by, "_lower"]).join(upper, [*by, "_upper"])
    part = F.col("_place") - F.col("_lower")
    value = F.when(part == 0, F.col("_lower_v")).otherwise((1 - part) * F.col("_lower_v") + part * F.col("_upper_v"))
    own = both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value.alias("v")))), lambda x: x["v"]).alias("quantiles"))
    return sizes.join(own, list(by))


def ranked_values(values: DataFrame, by: Sequence[str], ranks: DataFrame) -> DataFrame:
    """(by, _at, _v): the finite values at the ranks (by, n_rows, _at), which count from 0 in each class."""
    key = [*by, "_at"]
    whole = [F.lit(float("-inf")).alias("_low"), F.lit(float("inf")).alias("_high"), F.lit(0).cast("long").alias("_below")]
    parts = durable(ranks.select(*key, *whole, F.col("n_rows").alias("_n")))
    done = []
    while True:
        few = parts.filter(F.col("_n") <= FEW)
        place = (F.col("_at") - F.col("_below") + 1).cast("int")
        done.append(_within(values, by, few).groupBy(*key, "_below").agg(F.array_sort(F.collect_list("_v")).alias("s")).select(*key, F.element_at("s", place).alias("_v")))
        parts = parts.filter(F.col("_n") > FEW)
        if parts.isEmpty():
            break
        cut = durable(_cuts(values, by, parts))
        cell = F.lit(6)
        for k in (2, 1, 0):
            own = F.col("_cut")[k]
            cell = F.when(F.col("_v") < own, 2 * k).when(F.col("_v") == own, 2 * k + 1).otherwise(cell)
        counts = _within(values, by, cut).withColumn("_cell", cell).groupBy(*key).agg(F.array(*[F.count_if(F.col("_cell") == k) for k in range(7)]).alias("_counts"))
        parts = durable(_narrowed(cut.join(sent(counts), key), key))
        done.append(parts.filter("_n = 0").select(*key, F.col("_low").alias("_v")))
        parts = parts.filter("_n > 0")
    out = done[0]
    for own in done[1:]:
        out = out.unionByName(own)
    return durable(out)


def _within(values: DataFrame, by: Sequence[str], parts: DataFrame) -> DataFrame:
    return values.join(sent(parts), list(by)).filter((F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high")))


def _cuts(values: DataFrame, by: Sequence[str], parts: DataFrame) -> DataFrame:
    """The parts with three values of theirs: about where the rank is, and beside it. A part that ranks share has one sketch."""
    bounds = [*by, "_low", "_high"]
    sketches = _within(values, by, parts.select(*bounds).distinct()).groupBy(*bounds).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_sketch"))
    steps = sketches.withColumn("_steps", F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]))).drop("_sketch")
    near = F.round((F.col("_at") - F.col("_below") + 0.5) / F.col("_n") * STEPS).cast("int")
    first = F.least(F.greatest(near, F.lit(1)), F.lit(STEPS - 1))
    return parts.join(steps, bounds).withColumn("_cut", F.slice("_steps", first, 3)).drop("_steps")


def _narrowed(counted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each part cut down to the cell that holds its rank: what lies between two cuts, or a cut itself (no rows are left, it is the value)."""
    before = [F.lit(0).cast("long")]
    for k in range(7):
        before.append(before[-1] + F.col("_counts")[k])
    own = F.col("_at") - F.col("_below")
    bounds = [F.col("_low"), *[F.col("_cut")[k] for k in range(3)], F.col("_high")]
    cells = []
    for k in range(7):
        low, high = (bounds[k // 2 + 1],) * 2 if k % 2 else (bounds[k // 2], bounds[k // 2 + 1])
        left = F.lit(0).cast("long") if k % 2 else F.col("_counts")[k]
        cells.append(F.struct(low.alias("_low"), high.alias("_high"), (F.col("_below") + before[k]).alias("_below"), left.alias("_n")))
    chosen = cells[6]
    for k in reversed(range(6)):
        chosen = F.when(own < before[k + 1], cells[k]).otherwise(chosen)
    return counted.select(*key, chosen.alias("_c")).select(*key, "_c.*")
