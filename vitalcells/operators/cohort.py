"""Exclusion cascade and derived cohort columns."""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions import derive as D
from vitalcells.functions.normalize import code_text, label


@dataclass(frozen=True)
class Rules:
    """Ordered inclusion rules of the primary sample, and the extra sensitivity rule."""

    suffix: str
    steps: tuple[tuple[str, Column], ...]
    sensitivity: Column

    @property
    def primary_flag(self) -> str:
        return f"in_primary{self.suffix}"

    @property
    def sensitivity_flag(self) -> str:
        return f"in_sens{self.suffix}"


def valid_race() -> Column:
    return F.col("RACACORMAE").isin(*V.RACE)


def _steps(education_name: str, education_rule: Column, window) -> tuple:
    place = F.col("UF").isNotNull() & F.col("CODMUNRES").isNotNull()
    names = [name.format(edu=education_name) for name in V.STEP_NAMES]
    conditions = (
        valid_race(),
        F.col("SEMAGESTAC").between(*V.WEEKS_VALID),
        education_rule,
        F.col("IDADEMAE").between(*V.AGE_VALID),
        F.col("ANO").between(*window) & place,
    )
    return tuple(zip(names[1:6], conditions))


def main_rules(education: str, window, suffix: str = "") -> Rules:
    """Education in its valid range; unknown visits stay, unknown marital status leaves."""
    return Rules(
        suffix, _steps(education, D.education_valid(education), window),
        F.col("CONSULTAS").isNotNull() & F.col("ESTCIVMAE").isNotNull()
        & (F.col("ESTCIVMAE") != V.MARITAL_UNKNOWN))


def variant_rules(window, suffix: str = "_var") -> Rules:
    """The second team's choice: any known education code, parity must be known."""
    return Rules(
        suffix, _steps("ESCMAE2010", F.col("ESCMAE2010").isNotNull(), window),
        F.col("CONSULTAS").isNotNull() & F.col("QTDFILVIVO").isNotNull()
        & F.col("ESTCIVMAE").isNotNull())


def primary(rules: Rules) -> Column:
    return reduce(and_, [condition for _, condition in rules.steps])


def with_flags(births: DataFrame, rules: Rules) -> DataFrame:
    """Sample membership as columns of the whole table; no copy is made."""
    inside = F.coalesce(primary(rules), F.lit(False))
    return births.withColumns({
        rules.primary_flag: inside,
        rules.sensitivity_flag: inside & F.coalesce(rules.sensitivity, F.lit(False)),
    })


def running_steps(rules: Rules) -> list[tuple[str, Column]]:
    """Each step with the condition for rows that are left after it."""
    running, passed = [], None
    for name, condition in rules.steps:
        passed = condition if passed is None else passed & condition
        running.append((name, passed))
    return [(V.STEP_NAMES[0], F.lit(True)), *running, (V.STEP_NAMES[6], passed & rules.sensitivity)]


def cascade(births: DataFrame, rules: Rules) -> DataFrame:
    """Rows left after each step, all counted in one aggregation."""
    steps = running_steps(rules)
    counts = births.agg(*[F.count_if(keep).alias(f"n{i}") for i, (_, keep) in enumerate(steps)])
    pairs = F.array(*[F.struct(F.lit(i).alias("ordem"), F.lit(name).alias("passo"),
                               F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(steps)])
    return counts.select(F.inline(pairs))


def with_categories(births: DataFrame) -> DataFrame:
    return births.withColumns({
        "raca": label(F.col("RACACORMAE"), V.RACE),
        "ptb": D.preterm(F.col("SEMAGESTAC")),
        "idade_cat": D.age_band(F.col("IDADEMAE")),
        "esc_cat": D.education("ESCMAE"),
        "esc2010_cat": D.education("ESCMAE2010"),
        "esc2010_code": code_text(F.col("ESCMAE2010")),
        "ano_cat": code_text(F.col("ANO")),
        "cons_cat": D.visits(F.col("CONSULTAS")),
        "parid_cat": D.parity(F.col("QTDFILVIVO")),
        "parid_known": D.parity(F.col("QTDFILVIVO"), null_is_zero=False),
        "estciv_cat": code_text(F.col("ESTCIVMAE")),
        "singleton": F.col("GRAVIDEZ") == 1,
        "mesp1trim": D.first_trimester(F.col("MESPRENAT")).cast("string"),
    })


INCLUSION_GROUPS = ("Incluidos", "Excluidos(so raca-valida)", "Excluidos(cascata completa)")


def inclusion_groups(cohort: DataFrame, flag: str = "in_primary") -> DataFrame:
    """One row per (record, comparison group) it belongs to; the last two groups overlap."""
    inside = F.coalesce(F.col(flag), F.lit(False))
    has_race = F.coalesce(valid_race(), F.lit(False))
    member = F.array_compact(F.array(
        F.when(inside, INCLUSION_GROUPS[0]),
        F.when(has_race & ~inside, INCLUSION_GROUPS[1]),
        F.when(~inside, INCLUSION_GROUPS[2])))
    return cohort.withColumn("grupo", F.explode(member))


def period(year: Column, blocks: dict[str, tuple[int, int]]) -> Column:
    """Name of the period block a year falls in."""
    out = F.lit(None).cast("string")
    for name, window in blocks.items():
        out = F.when(year.between(*window), name).otherwise(out)
    return out
