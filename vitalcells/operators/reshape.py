"""Dense grids, shares, differences, wide and long forms."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(counts: DataFrame, base: DataFrame, levels: dict[str, list], n: str = "n") -> DataFrame:
    """Every row of `base` with every listed level, and zero where `counts` has no such row."""
    grid = with_levels(base, levels)
    keys = [c for c in grid.columns if c in counts.columns]
    return grid.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def with_levels(base: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Repeat the rows of a report dimension for the listed values of others."""
    for name, values in levels.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base


def percent(part: Column, whole: Column) -> Column:
    return 100 * F.try_divide(part.cast("double"), whole.cast("double"))


def share_of_total(report: DataFrame, n: str, *by: str) -> Column:
    """Percentage of the total over a report-sized table."""
    return percent(F.col(n), F.sum(n).over(Window.partitionBy(*by)))


def versus(value: Column, is_reference: Column, *by: str) -> Column:
    """Difference from the reference row."""
    return value - F.max(F.when(is_reference, value)).over(Window.partitionBy(*by))


def excluded_per_step(steps: DataFrame) -> DataFrame:
    before = F.lag("n").over(Window.partitionBy().orderBy("ordem"))
    return steps.withColumn("excluidos", before - F.col("n"))


def attenuation(ratio: Column, crude: Column, digits: int | None = 3) -> Column:
    """Percent of the excess crude ratio removed; uses ratios as reported unless digits is None."""
    if digits is not None:
        ratio, crude = F.round(ratio, digits), F.round(crude, digits)
    percent_removed = 100 * F.try_divide(crude - ratio, crude - 1)
    return F.when(percent_removed == 0, F.lit(0.0)).otherwise(percent_removed)


def long_form(wide: DataFrame, keys: list[str], parts: dict[str, list[Column]],
              names: list[str], label: str) -> DataFrame:
    """One row per entry of `parts`, which maps a label to its value columns."""
    rows = F.array(*[
        F.struct(F.lit(text).alias(label), *[v.alias(n) for v, n in zip(values, names)])
        for text, values in parts.items()])
    return wide.select(*keys, F.inline(rows))


def first_rows(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in the order of their first appearance (column `ordem`)."""
    return df.groupBy(value).agg(F.min("ordem").alias("ordem"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
