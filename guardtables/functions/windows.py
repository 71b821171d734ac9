"""Running totals and order statistics that do not put a hot key into one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, slice_of: Column, out: str
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` per key in ``order``.

    A window over a whole key would sort a hot key in one task. Rows are summed inside
    slices of the order (``slice_of`` must not decrease along it), and the slices' totals,
    aggregated before the shuffle, give each slice its starting point.
    """
    sliced = df.withColumn("_slice", slice_of).withColumn("_value", value)
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        sliced.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_slice", "_value")
    )


def latest_before(
    df: DataFrame, keys: list[str], order: Column, slice_of: Column, value: Column, out: str, strict: bool = True
) -> DataFrame:
    """Add ``out``: the latest non-NULL ``value`` of a key before each row in ``order``.

    Inside a slice it is a window; across slices it comes from one row per slice, so a hot
    key spreads over its slices. ``order`` must be a number or time; rows of equal order do
    not see each other when ``strict``.
    """
    sliced = df.withColumns({"_slice": slice_of, "_order": order, "_value": value})
    frame = W.partitionBy(*keys, "_slice").orderBy("_order")
    frame = frame.rangeBetween(W.unboundedPreceding, -1) if strict else frame.rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_order"))).alias("_end"))
        .withColumn("_before", F.last("_end", ignorenulls=True).over(before))
        .drop("_end")
    )
    return (
        sliced.withColumn("_inside", F.last("_value", ignorenulls=True).over(frame))
        .join(ends, [*keys, "_slice"])
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_inside", "_before", "_slice", "_order", "_value")
    )


def trailing(
    df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float, sums: dict[str, Column]
) -> DataFrame:
    """Add trailing sums over the last ``seconds`` (older rows excluded at exactly that age).

    Rows are counted in arrival order: rows with the same time count only up to their tie
    breaker. Time is cut into slices as long as the window and every row is also shown to
    the next slice, so a key spreads over as many groups as it has slices.
    """
    micros = F.unix_micros(F.col(ts))
    width = int(round(seconds * 1_000_000))
    names = {name: f"_sum_{i}" for i, name in enumerate(sums)}
    base = df.select(
        "*", micros.alias("_us"), ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint").alias("_at"),
        *[value.alias(names[name]) for name, value in sums.items()],
    )
    shown = base.withColumn("_slice", F.explode(F.array(F.col("_at"), F.col("_at") + 1)))
    window = W.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-(width - 1), W.currentRow)
    # Peers later in the arrival order are taken out again.
    peers = W.partitionBy(*keys, "_slice", "_us").orderBy(tie).rowsBetween(1, W.unboundedFollowing)
    totals = {
        name: F.coalesce(F.sum(col).over(window), F.lit(0)) - F.coalesce(F.sum(col).over(peers), F.lit(0))
        for name, col in names.items()
    }
    return (
        shown.withColumns(totals)
        .where(F.col("_slice") == F.col("_at"))
        .drop("_us", "_at", "_slice", *names.values())
    )


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], step: float = 1.0
) -> DataFrame:
    """Exact order statistics per key: ``ranks`` gives 0-based positions from the count ``n``.

    Values are counted first, so the rows that travel are the distinct values, and their
    running counts are taken in slices of ``step``.
    """
    if not keys:
        return order_statistics(df.withColumn("_all", F.lit(0)), ["_all"], value, ranks, step).drop("_all")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_copies"))
    sizes = counted.groupBy(*keys).agg(F.sum("_copies").alias("n"))
    ran = running_total(
        counted, keys, [F.col(value)], F.col("_copies"), F.floor(F.col(value) / F.lit(step)), "_upto"
    )
    placed = ran.join(sizes, keys)
    picks = {
        name: F.max(
            F.when((rank >= F.col("_upto") - F.col("_copies")) & (rank < F.col("_upto")), F.col(value))
        ).alias(name)
        for name, rank in ranks.items()
    }
    return placed.groupBy(*keys, "n").agg(*picks.values())


def interpolated(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], step: float = 1.0) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbours."""
    position = {name: (F.col("n") - 1) * F.lit(q) for name, q in fractions.items()}
    ranks = {}
    for name, at in position.items():
        ranks[f"_{name}_lo"] = F.floor(at)
        ranks[f"_{name}_hi"] = F.ceil(at)
    got = order_statistics(df, keys, value, ranks, step)
    return got.select(
        *keys, "n",
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (position[name] - F.floor(position[name]))
            ).alias(name)
            for name in fractions
        ],
    )
