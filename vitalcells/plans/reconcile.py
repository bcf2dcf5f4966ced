"""Comparison of two teams' result tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V


def focal_rows(effects: DataFrame) -> DataFrame:
    return effects.where(F.col("grupo") == V.RACE_FOCAL)


def compare(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str,
            how: str = "inner") -> DataFrame:
    """Both values and their difference. 'right' keeps every key the other team reports."""
    left = ours.select(*keys, F.col(value).cast("double").alias("nosso"))
    right = theirs.select(*keys, F.col(value).cast("double").alias("referencia"))
    return left.join(right, keys, how).withColumn("delta", F.col("nosso") - F.col("referencia"))


def sample_sizes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every sample size the other team reports; ratio rows are compared elsewhere."""
    sizes = theirs.where(~F.col("amostra").startswith("OR_"))
    return compare(ours, sizes, ["amostra"], "n", "right")


def ratios_by_model(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return compare(focal_rows(ours), focal_rows(theirs), ["modelo", "grupo"], "estimativa")


def ratios_by_measure(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Odds and prevalence ratios of the focal group, also where the other team has none."""
    return compare(focal_rows(ours), focal_rows(theirs), ["modelo", "grupo", "medida"],
                   "estimativa", "left")


def probabilities(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    groups = ours.sparkSession.createDataFrame([(g,) for g in V.RACE_LEVELS], "grupo string")
    return groups.join(compare(ours, theirs, ["grupo"], "p_ajustada_pct", "full"), "grupo", "left")


def year_counts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return compare(ours, theirs, ["ano"], "n")


def published_ratios(effects: DataFrame) -> DataFrame:
    """Focal odds ratios beside the published ones, matched on the model's short name."""
    published = effects.sparkSession.createDataFrame(
        list(V.PUBLISHED_FOCAL_OR.items()), "curto string, publicado double")
    short = F.split("modelo", "_")[0]
    return (focal_rows(effects).withColumn("curto", short).join(published, "curto", "left")
            .select("modelo", "estimativa", "aic", "n", "publicado"))


def audit_numbers(audit: DataFrame) -> DataFrame:
    """Parameters and AIC of each audited model as (metrica, valor)."""
    return audit.select(F.inline(F.array(
        F.struct(F.concat("modelo", F.lit(" n_params")).alias("metrica"), F.col("n_params").cast("double").alias("valor")),
        F.struct(F.concat("modelo", F.lit(" aic")).alias("metrica"), F.round("aic", 2).alias("valor")))))


def exclusion_numbers(groups: DataFrame) -> DataFrame:
    """The comparison of included and excluded rows as (metrica, valor)."""
    values = [c for c in groups.columns if c != "grupo"]
    return groups.select(F.inline(F.array(*[
        F.struct(F.concat_ws(" ", "grupo", F.lit(c)).alias("metrica"), F.col(c).cast("double").alias("valor"))
        for c in values])))


def section(table: DataFrame, name: str, key: Column) -> DataFrame:
    """A comparison as rows of the long reconciliation table."""
    return table.select(F.lit(name).alias("secao"), key.cast("string").alias("metrica"),
                        "nosso", "referencia", "delta")
