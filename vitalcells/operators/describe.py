"""Descriptive tables of the cohort, each from one pass over the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import first_trimester, severity_band, share
from vitalcells.operators.reshape import dense, long_form, percent, share_of_total

TOTAL = "TOTAL"


def by_group_and_total(rows: DataFrame, group: str, measures: list[Column]) -> DataFrame:
    """Measures per group and over all rows; a null group is not taken for the total."""
    name = F.when(F.grouping(group) == 1, TOTAL).otherwise(F.col(group))
    return rows.rollup(group).agg(name.alias("grupo"), *measures).drop(group)


def outcome_measures() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("ptb").alias("ptb_n"), share(F.col("ptb")).alias("ptb_pct")]


def table1(cohort: DataFrame, states: list[str], primary: str = "in_primary",
           sensitivity: str = "in_sens") -> DataFrame:
    """Characteristics per group; visit columns use the sensitivity rows of the same pass."""
    weeks, sens = F.col("SEMAGESTAC"), F.col(sensitivity)

    def within(flag):
        return share(F.when(sens, flag))

    measures = [
        *outcome_measures(),
        share(severity_band(weeks, None, 28)).alias("ptb_ext_pct"),
        share(severity_band(weeks, 28, 32)).alias("ptb_muito_pct"),
        share(severity_band(weeks, 32, V.PRETERM_WEEKS)).alias("ptb_mod_pct"),
        F.avg("IDADEMAE").alias("idade_media"),
        F.stddev_samp("IDADEMAE").alias("idade_sd"),
        share(F.col("idade_cat") == "<20").alias("idade_lt20_pct"),
        share(F.col("idade_cat") == "20-34").alias("idade_2034_pct"),
        share(F.col("idade_cat") == ">=35").alias("idade_ge35_pct"),
        *[share(F.col("ESCMAE") == code).alias(f"esc_{text}_pct")
          for code, text in V.EDUCATION.items()],
        *[share(F.col("UF") == uf).alias(f"estado_{uf}_pct") for uf in states],
        F.count_if(sens).alias("n_sens"),
        *[within(F.col("CONSULTAS") == code).alias(f"cons_{text}_pct")
          for code, text in V.VISITS.items()],
        within(F.col("MESPRENAT").between(1, 3)).alias("mesprenat_1trim_pct"),
    ]
    return by_group_and_total(cohort.where(F.col(primary)), "raca", measures)


def table1_national(cohort: DataFrame) -> DataFrame:
    return by_group_and_total(cohort.where("in_primary"), "raca", [
        *outcome_measures(),
        F.avg("IDADEMAE").alias("idade_media"),
        share(F.col("idade_cat") == "<20").alias("idade_lt20_pct"),
        share(F.col("idade_cat") == ">=35").alias("idade_ge35_pct"),
    ])


def prevalence(cohort: DataFrame, *by: str) -> DataFrame:
    return cohort.where("in_primary").groupBy(*by).agg(*outcome_measures())


def prevalence_grid(cohort: DataFrame, states: DataFrame) -> DataFrame:
    """Prevalence for every state and group, also the empty ones."""
    grid = dense(prevalence(cohort, "UF", "raca"), states, {"raca": list(V.RACE_LEVELS)})
    return grid.withColumn("ptb_n", F.coalesce("ptb_n", F.lit(0)))


def focal_by_region(cohort: DataFrame) -> DataFrame:
    counts = (cohort.where(F.col("in_primary") & (F.col("raca") == V.RACE_FOCAL))
              .groupBy("regiao").agg(F.count("*").alias("n_focal")))
    return counts.withColumn("pct_focal", share_of_total(counts, "n_focal"))


def missing_rules() -> dict[str, Column]:
    """Missing or implausible, per variable. Visits and marital code 9 count as present here."""
    def outside(name, low, high):
        return F.col(name).isNull() | ~F.col(name).between(low, high)

    return {
        "SEMAGESTAC": outside("SEMAGESTAC", *V.WEEKS_VALID),
        "RACACORMAE": F.col("RACACORMAE").isNull(),
        "IDADEMAE": outside("IDADEMAE", *V.AGE_VALID),
        "ESCMAE": outside("ESCMAE", 1, 5),
        "CONSULTAS": F.col("CONSULTAS").isNull(),
        "MESPRENAT": F.col("MESPRENAT").isNull() | (F.col("MESPRENAT") == 99),
        "QTDFILVIVO": F.col("QTDFILVIVO").isNull(),
        "ESTCIVMAE": F.col("ESTCIVMAE").isNull(),
        "CODMUNRES": F.col("CODMUNRES").isNull(),
    }


def missing_by_group(cohort: DataFrame) -> DataFrame:
    """Missing values per variable and group among rows with a valid exposure."""
    rules = missing_rules()
    wide = by_group_and_total(cohort.where(F.col("raca").isNotNull()), "raca", [
        F.count("*").alias("n"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()]])
    parts = {V.MISSING_LABELS[name]: [F.col(name), percent(F.col(name), F.col("n"))]
             for name in rules}
    return long_form(wide, ["grupo", "n"], parts, ["missing_n", "missing_pct"], "variavel")


def included_vs_excluded(members: DataFrame) -> DataFrame:
    """Compare inclusion groups (rows from `inclusion_groups`).

    The group mix is over labelled rows, the other-or-missing share over all rows, and the
    outcome over rows with known weeks.
    """
    race = F.col("RACACORMAE")
    labelled = F.count("raca")
    return members.groupBy("grupo").agg(
        F.count("*").alias("n"),
        share(F.col("ptb")).alias("ptb_pct"),
        F.count("ptb").alias("ptb_definido_n"),
        F.avg("IDADEMAE").alias("idade_media"),
        *[F.coalesce(percent(F.count_if(F.col("raca") == text), labelled), F.lit(0.0))
          .alias(f"raca_{text.lower()}_pct") for text in V.RACE_LEVELS],
        share(race.isNull() | (race == V.RACE_OTHER_CODE)).alias("raca_outra_missing_pct"),
        share(F.coalesce(race == 9, F.lit(False))).alias("raca_codigo9_pct"))


def exposure_missing_grid(births: DataFrame, years: list[int], states: DataFrame) -> DataFrame:
    """Exposure missing, other and unknown code for every year and state, on all rows."""
    race = F.col("RACACORMAE")
    counts = births.groupBy("ANO", "UF").agg(
        F.count("*").alias("n_total"),
        F.count_if(race.isNull()).alias("missing_n"),
        F.count_if(race == V.RACE_OTHER_CODE).alias("outra_n"),
        F.count_if(race == 9).alias("codigo9_n"))
    return exposure_grid(counts, years, states)


def exposure_grid(counts: DataFrame, years: list[int], states: DataFrame) -> DataFrame:
    """Counts per year and state with the empty combinations and percentages."""
    grid = dense(counts, states, {"ANO": years}, "n_total")
    return grid.select(
        "ANO", "UF", "n_total",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("missing_n", "outra_n", "codigo9_n")],
        percent(F.col("missing_n"), F.col("n_total")).alias("missing_pct"),
        percent(F.col("outra_n"), F.col("n_total")).alias("outra_pct"))


def first_trimester_by_group(cohort: DataFrame) -> DataFrame:
    """Share starting care in months 1-3 among sensitivity rows with a month of 1-9."""
    start = first_trimester(F.col("MESPRENAT"))
    return cohort.where("in_sens").groupBy(F.col("raca").alias("grupo")).agg(
        F.count(start).alias("n"), share(start).alias("inicio_1trim_pct"))


def sample_sizes(cohort: DataFrame, last_year: int, states: list[str]) -> DataFrame:
    """Sizes of the samples used by the analyses, counted in one aggregation."""
    primary, sens = F.col("in_primary"), F.col("in_sens")
    conditions = {
        "primaria_M1-5": primary,
        "sensibilidade_M6-8": sens,
        "singletons_primaria": primary & F.col("singleton"),
        "singletons_sensib": sens & F.col("singleton"),
        "mesprenat_subsample": sens & F.col("MESPRENAT").between(1, 9),
        "sem_ultimo_ano_primaria": primary & (F.col("ANO") != last_year),
        "sem_ultimo_ano_sensib": sens & (F.col("ANO") != last_year),
        "ultimo_ano_contribuicao": primary & (F.col("ANO") == last_year),
    }
    for uf in states:
        conditions[f"{uf}_M5_n"] = primary & (F.col("UF") == uf)
        conditions[f"{uf}_M8_n"] = sens & (F.col("UF") == uf)
    wide = cohort.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    return long_form(wide, [], {k: [F.col(f"c{i}")] for i, k in enumerate(conditions)},
                     ["n"], "amostra")


def with_canonical_ratio(sizes: DataFrame, ratio: DataFrame) -> DataFrame:
    """Sample sizes and, as one more row, the full model's focal odds ratio to three places."""
    row = ratio.select(F.lit("OR_M8_canonico_Indig").alias("amostra"), F.round("focal_or", 3).alias("n"))
    return sizes.withColumn("n", F.col("n").cast("double")).unionByName(row)
