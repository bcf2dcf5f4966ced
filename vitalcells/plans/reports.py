"""Report tables built from result tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.text import count_text, decimal_text, interval_text
from vitalcells.operators.reshape import attenuation, union_all

GROUPS = V.RACE_LEVELS[1:]


def short_name(model: Column) -> Column:
    return F.split(model, "_")[0]


def ratios_beside_odds(odds: DataFrame, rates: DataFrame) -> DataFrame:
    """Prevalence ratios attached to the odds ratios of the same model; some models have none."""
    attached = rates.select(
        short_name(F.col("modelo")).alias("curto"), "grupo", F.col("estimativa").alias("razao"),
        F.col("ic_low").alias("razao_low"), F.col("ic_high").alias("razao_high"))
    return (odds.withColumn("curto", short_name(F.col("modelo")))
            .join(attached, ["curto", "grupo"], "left").drop("curto"))


def with_attenuation(odds: DataFrame, digits: int | None = 3) -> DataFrame:
    """Percent attenuation of each odds ratio against the crude model of its group."""
    crude = F.max(F.when(F.col("modelo") == V.LADDER[0][0], F.col("estimativa"))).over(
        Window.partitionBy("grupo"))
    return odds.withColumn("atenuacao_pct", attenuation(F.col("estimativa"), crude, digits))


def revised_table2(odds: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per model with text cells for every group, in the report's column order."""
    table = with_attenuation(ratios_beside_odds(odds, rates)).select(
        "modelo", "grupo", "n",
        decimal_text(F.col("estimativa")).alias("OR"),
        interval_text(F.col("ic_low"), F.col("ic_high")).alias("IC"),
        decimal_text(F.col("razao")).alias("PR"),
        F.when(F.col("razao").isNull(), "").otherwise(
            interval_text(F.col("razao_low"), F.col("razao_high"))).alias("PR_IC"),
        decimal_text(F.col("atenuacao_pct"), 1).alias("atenuacao"))
    cells = ("OR", "IC", "PR", "PR_IC", "atenuacao")
    wide = table.groupBy("modelo").pivot("grupo", list(GROUPS)).agg(
        F.first("n").alias("n"), *[F.first(c).alias(c) for c in cells])
    return wide.select(
        F.replace("modelo", F.lit("_"), F.lit(" ")).alias("modelo"),
        count_text(F.col(f"{V.RACE_FOCAL}_n")).alias("n"),
        *[F.col(f"{g}_{c}").alias(f"{g.lower()}_{c.lower()}") for g in GROUPS for c in cells[:4]],
        F.col(f"{V.RACE_FOCAL}_atenuacao").alias("indigena_pct_atenuacao"))


def forest(odds: DataFrame, rates: DataFrame) -> DataFrame:
    """Odds and prevalence ratios with intervals, per model and group, in long form."""
    def series(table, name):
        return table.select(short_name(F.col("modelo")).alias("modelo"), "grupo",
                            F.lit(name).alias("serie"), "estimativa", "ic_low", "ic_high")

    return series(odds, "OR").unionByName(series(rates, "PR"))


def yearly_series(effects: DataFrame) -> DataFrame:
    """Focal ratios of the yearly models in year order."""
    return (effects.where((F.col("grupo") == V.RACE_FOCAL) & F.col("modelo").startswith("Ano_"))
            .select(F.split("modelo", "_")[1].cast("int").alias("ano"), "estimativa", "ic_low",
                    "ic_high", "n")
            .orderBy("ano"))


def largest_states(prevalence: DataFrame, top: int = 20) -> DataFrame:
    """Reference and focal prevalence of the states with most focal rows, largest first."""
    wide = (prevalence.groupBy("UF", "regiao").pivot("raca", [V.RACE_REFERENCE, V.RACE_FOCAL])
            .agg(F.first("ptb_pct").alias("pct"), F.first("n").alias("n")))
    n = F.col(f"{V.RACE_FOCAL}_n")
    best = wide.where(n.isNotNull()).orderBy(n.desc(), "UF").limit(top)
    rank = F.row_number().over(Window.partitionBy().orderBy(n.desc(), "UF"))
    return best.select(
        rank.alias("posicao"), F.col("UF").alias("uf"), "regiao", n.alias("n_focal"),
        F.col(f"{V.RACE_REFERENCE}_pct").alias("branca_pct"),
        F.col(f"{V.RACE_FOCAL}_pct").alias("indigena_pct"))


def numbers(section: str, table: DataFrame, metric: Column, key: Column, value: Column,
            text: Column, reference: Column | None = None) -> DataFrame:
    """One section of the consolidated numbers, with the other team's value where there is one."""
    other = (F.lit(None) if reference is None else reference).cast("double")
    return table.select(F.lit(section).alias("secao"), metric.cast("string").alias("metrica"),
                        key.cast("string").alias("chave"), value.cast("double").alias("valor"),
                        text.alias("texto"), other.alias("referencia"),
                        (value.cast("double") - other).alias("delta"))


def consolidated(sections: list[DataFrame], expected: DataFrame) -> DataFrame:
    """All sections, and a FALTA row for every expected (secao, metrica) without a number."""
    found = union_all(sections)
    gaps = expected.join(found.where("valor is not null"), ["secao", "metrica"], "left_anti").select(
        F.lit("pendencias").alias("secao"), "metrica", F.lit("").alias("chave"),
        F.lit(None).cast("double").alias("valor"),
        F.concat(F.lit("FALTA: "), "secao", F.lit(" "), "metrica").alias("texto"),
        F.lit(None).cast("double").alias("referencia"), F.lit(None).cast("double").alias("delta"))
    return found.unionByName(gaps)


def extremes(grid: DataFrame, value: str) -> DataFrame:
    """Lowest and highest value and the first row, by year and state, that has it."""
    known = grid.where(F.col(value).isNotNull())
    low = F.min(F.struct(F.col(value).alias("v"), "ano", "uf"))
    high = F.min(F.struct((-F.col(value)).alias("v"), "ano", "uf"))
    return known.agg(low.alias("a"), high.alias("b")).select(
        F.col("a.v").alias("minimo"), F.col("a.ano").alias("min_ano"), F.col("a.uf").alias("min_uf"),
        (-F.col("b.v")).alias("maximo"), F.col("b.ano").alias("max_ano"), F.col("b.uf").alias("max_uf"))
