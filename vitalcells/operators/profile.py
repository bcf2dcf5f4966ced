"""Profiles of the cleaned raw text of every year (rows from `scan_years`)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.normalize import number, state_code
from vitalcells.operators.reshape import long_form, percent


def rows_per_year(scan: DataFrame) -> DataFrame:
    return scan.groupBy("ano").agg(F.count("*").alias("n"))


def missingness(scan: DataFrame, present: DataFrame) -> DataFrame:
    """Null and unknown-code counts per year and variable.

    `present` has one (ano, variavel) row per column that the year's file really has.
    """
    unknown = {c: F.count_if(F.col(c) == V.UNKNOWN_CODE[c]) for c in V.PROFILED if c in V.UNKNOWN_CODE}
    wide = scan.groupBy("ano").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in V.PROFILED],
        *[count.alias(f"ign_{c}") for c, count in unknown.items()])
    none = F.lit(None).cast("bigint")
    parts = {c: [F.col(f"null_{c}"), F.lit(V.UNKNOWN_CODE.get(c)),
                 F.col(f"ign_{c}") if c in unknown else none] for c in V.PROFILED}
    table = long_form(wide, ["ano", "n"], parts, ["n_null", "cod_ign", "n_ign"], "variavel")
    table = table.join(present.withColumn("ok", F.lit(True)), ["ano", "variavel"], "left")

    def if_present(value: Column) -> Column:
        return F.when(F.col("ok"), value)

    return table.select(
        "ano", "variavel", "n",
        if_present(F.col("n_null")).alias("n_null"),
        if_present(percent(F.col("n_null"), F.col("n"))).alias("pct_null"),
        if_present(F.col("cod_ign")).alias("cod_ign"),
        if_present(F.col("n_ign")).alias("n_ign"),
        if_present(percent(F.col("n_ign"), F.col("n"))).alias("pct_ign"),
        F.when(F.col("ok"), "ok").otherwise("AUSENTE").alias("status"))


def code_distribution(scan: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Code counts per year with labels and the share of the year."""
    counts = scan.groupBy("ano", F.col(column).alias("codigo")).agg(F.count("*").alias("n"))
    text = F.when(F.col("codigo").isNull(), "(null/missing)")
    for code, name in labels.items():
        text = text.when(F.col("codigo") == code, name)
    return counts.select(
        "ano", F.coalesce("codigo", F.lit("(null)")).alias("codigo"),
        text.otherwise("—").alias("label"), "n",
        percent(F.col("n"), F.sum("n").over(Window.partitionBy("ano"))).alias("pct"))


def number_range(scan: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Range, nearest-rank percentiles and implausible tails per year.

    Values are counted first, so the window sees distinct values and not rows.
    """
    counts = (scan.groupBy("ano", number(F.col(column)).alias("v"), F.col(column).isNull().alias("blank"))
              .agg(F.count("*").alias("k")))
    by_value = Window.partitionBy("ano").orderBy("v")
    year = Window.partitionBy("ano")
    known = F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0)
    ranked = counts.select(
        "*", F.sum(known).over(by_value).alias("upto"), F.sum(known).over(year).alias("m"))

    def percentile(q):
        rank = F.floor(q * (F.col("m") - 1) + 0.5)
        return F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > rank), F.col("v")))

    def total(condition):
        return F.sum(F.when(condition, F.col("k")).otherwise(0))

    n = F.sum("k")
    return ranked.groupBy("ano").agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        *[percentile(q).alias(name) for q, name in ((0.01, "p1"), (0.5, "p50"), (0.99, "p99"))],
        total(F.col("v") < low).alias("n_lt"), percent(total(F.col("v") < low), n).alias("pct_lt"),
        total(F.col("v") > high).alias("n_gt"), percent(total(F.col("v") > high), n).alias("pct_gt"),
        percent(total(F.col("blank")), n).alias("pct_null"))


def state_counts(scan: DataFrame) -> DataFrame:
    """Rows per year and unpadded two-digit state prefix."""
    return scan.groupBy("ano", state_code(F.col("CODMUNRES")).alias("uf_code")).agg(
        F.count("*").alias("n"))


def focus_share(scan: DataFrame, codes: list[str]) -> DataFrame:
    inside = F.count_if(state_code(F.col("CODMUNRES")).isin(codes))
    return scan.groupBy("ano").agg(
        F.count("*").alias("total_nacional"), inside.alias("total_foco"),
        percent(inside, F.count("*")).alias("pct_foco"))
