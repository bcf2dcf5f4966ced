"""All counts of the reports from one pass over the records.

The cube holds conditional counts by state, year and exposure group; every descriptive section of a
report is a small sum over it, so a report reads the records once, whatever its number of sections.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.operators import describe as D
from vitalcells.operators.cohort import INCLUSION_GROUPS, Rules, running_steps
from vitalcells.operators.reshape import long_form, percent, union_all

KEYS = ("UF", "ANO", "raca")


def _sample_counts(prefix: str, primary: str, sensitivity: str) -> dict[str, Column]:
    """Counts of one pair of samples, and of what its primary sample leaves out."""
    inside, sens = F.col(primary), F.col(sensitivity)
    race = F.col("RACACORMAE")
    unlabelled = race.isNull() | (race == V.RACE_OTHER_CODE)
    single = F.coalesce(F.col("singleton"), F.lit(False))
    month = F.coalesce(F.col("MESPRENAT").between(1, 9), F.lit(False))
    conditions = {"in": inside, "sens": sens, "in_single": inside & single, "sens_single": sens & single,
                  "sens_month": sens & month, "sens_start": sens & month & (F.col("MESPRENAT") <= 3),
                  "in_known": inside & F.col("ptb").isNotNull(), "in_ptb": inside & (F.col("ptb") == 1),
                  "out_known": ~inside & F.col("ptb").isNotNull(), "out_ptb": ~inside & (F.col("ptb") == 1),
                  "in_other": inside & unlabelled, "out_other": ~inside & unlabelled}
    return {f"{prefix}_{name}": F.count_if(condition) for name, condition in conditions.items()}


def measure_cube(cohort: DataFrame, rules: Rules, samples: dict[str, tuple[str, str]]) -> DataFrame:
    """The cube of a flagged cohort; `samples` names the flags of each pair of samples by prefix."""
    race = F.col("RACACORMAE")
    measures = {"n": F.count("*"), "exposure_missing": F.count_if(race.isNull()),
                "exposure_other": F.count_if(race == V.RACE_OTHER_CODE), "exposure_9": F.count_if(race == 9)}
    for i, (_, keep) in enumerate(running_steps(rules)):
        measures[f"step_{i}"] = F.count_if(keep)
    for name, rule in D.missing_rules().items():
        measures[f"missing_{name}"] = F.count_if(rule)
    for prefix, flags in samples.items():
        measures.update(_sample_counts(prefix, *flags))
    return cohort.groupBy(*KEYS).agg(*[m.alias(name) for name, m in measures.items()])


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def sizes(cube: DataFrame, prefix: str, last_year: int) -> DataFrame:
    """amostra, n: the samples of the analyses."""
    last = F.col("ANO") == last_year
    columns = {"primaria_M1-5": F.col(f"{prefix}_in"), "sensibilidade_M6-8": F.col(f"{prefix}_sens"),
               "singletons_primaria": F.col(f"{prefix}_in_single"),
               "singletons_sensib": F.col(f"{prefix}_sens_single"),
               "mesprenat_subsample": F.col(f"{prefix}_sens_month"),
               "sem_ultimo_ano_primaria": F.when(~last, F.col(f"{prefix}_in")),
               "sem_ultimo_ano_sensib": F.when(~last, F.col(f"{prefix}_sens")),
               "ultimo_ano_contribuicao": F.when(last, F.col(f"{prefix}_in"))}
    wide = cube.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"c{i}") for i, c in enumerate(columns.values())])
    return long_form(wide, [], {k: [F.col(f"c{i}")] for i, k in enumerate(columns)}, ["n"], "amostra")


def year_counts(cube: DataFrame, prefix: str) -> DataFrame:
    return (cube.groupBy(F.col("ANO").alias("ano")).agg(F.sum(f"{prefix}_in").alias("n")).where("n > 0"))


def cascade(cube: DataFrame, rules: Rules) -> DataFrame:
    """ordem, passo, n: records left after each step."""
    steps = [name for name, _ in running_steps(rules)]
    wide = cube.agg(*_sums(*[f"step_{i}" for i in range(len(steps))]))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordem"), F.lit(name).alias("passo"), F.coalesce(f"step_{i}", F.lit(0)).alias("n"))
        for i, name in enumerate(steps)])))


def prevalence(cube: DataFrame, prefix: str, *by: str) -> DataFrame:
    """n, ptb_n and ptb_pct of the primary sample."""
    known = F.sum(f"{prefix}_in_known")
    return cube.groupBy(*by).agg(
        F.sum(f"{prefix}_in").alias("n"), F.sum(f"{prefix}_in_ptb").alias("ptb_n"),
        percent(F.sum(f"{prefix}_in_ptb"), known).alias("ptb_pct")).where("n > 0")


def missing_by_group(cube: DataFrame) -> DataFrame:
    """grupo, n, variavel, missing_n, missing_pct among rows with a valid exposure."""
    names = list(D.missing_rules())
    wide = (cube.where(F.col("raca").isNotNull()).groupBy(F.col("raca").alias("grupo"))
            .agg(*_sums("n", *[f"missing_{c}" for c in names])))
    parts = {V.MISSING_LABELS[c]: [F.col(f"missing_{c}"), percent(F.col(f"missing_{c}"), F.col("n"))] for c in names}
    return long_form(wide, ["grupo", "n"], parts, ["missing_n", "missing_pct"], "variavel")


def exposure_grid(cube: DataFrame, years: list[int], states: DataFrame) -> DataFrame:
    """Missing, other and unknown exposure for every year and state."""
    counts = cube.groupBy("ANO", "UF").agg(
        F.sum("n").alias("n_total"), F.sum("exposure_missing").alias("missing_n"),
        F.sum("exposure_other").alias("outra_n"), F.sum("exposure_9").alias("codigo9_n"))
    return D.exposure_grid(counts, years, states)


def included_vs_excluded(cube: DataFrame, prefix: str) -> DataFrame:
    """grupo, n, ptb_pct, focal share of the labelled rows, other-or-missing share of all rows."""
    focal, labelled = F.col("raca") == V.RACE_FOCAL, F.col("raca").isNotNull()
    inside, outside = F.col(f"{prefix}_in"), F.col("n") - F.col(f"{prefix}_in")

    def group(name, rows, side):
        members = inside if side == "in" else outside
        return (cube.where(rows).agg(
            F.coalesce(F.sum(members), F.lit(0)).alias("n"),
            percent(F.sum(f"{prefix}_{side}_ptb"), F.sum(f"{prefix}_{side}_known")).alias("ptb_pct"),
            F.coalesce(percent(F.sum(F.when(focal, members)), F.sum(F.when(labelled, members))), F.lit(0.0))
            .alias(f"raca_{V.RACE_FOCAL.lower()}_pct"),
            percent(F.sum(f"{prefix}_{side}_other"), F.sum(members)).alias("raca_outra_missing_pct"))
            .select(F.lit(name).alias("grupo"), "*"))

    return union_all([group(INCLUSION_GROUPS[0], F.lit(True), "in"), group(INCLUSION_GROUPS[1], labelled, "out"),
                      group(INCLUSION_GROUPS[2], F.lit(True), "out")])


def first_trimester(cube: DataFrame, prefix: str) -> DataFrame:
    """Share starting care in months 1-3 among sensitivity rows with a known month, per group."""
    return (cube.groupBy(F.col("raca").alias("grupo"))
            .agg(F.sum(f"{prefix}_sens_month").alias("n"), F.sum(f"{prefix}_sens").alias("of_group"),
                 percent(F.sum(f"{prefix}_sens_start"), F.sum(f"{prefix}_sens_month")).alias("inicio_1trim_pct"))
            .where("of_group > 0").drop("of_group"))
