"""Categories derived from the normalised columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.normalize import code_text, label

EDUCATION_VARIABLES = {
    "ESCMAE": ((1, 5), V.EDUCATION),
    "ESCMAE2010": ((0, 5), V.EDUCATION_2010),
}


def preterm(weeks: Column) -> Column:
    """1 below 37 weeks, 0 otherwise, null when the weeks are unknown."""
    return (weeks < V.PRETERM_WEEKS).cast("int")


def severity_band(weeks: Column, low: int | None, high: int) -> Column:
    inside = weeks < high if low is None else (weeks >= low) & (weeks < high)
    return inside.cast("int")


def age_band(age: Column) -> Column:
    """(9,19], (19,34], (34,60]; null outside."""
    return (F.when(age <= 9, None).when(age <= 19, "<20").when(age <= 34, "20-34")
            .when(age <= 60, ">=35"))


def education(variable: str) -> Column:
    _, labels = EDUCATION_VARIABLES[variable]
    return label(F.col(variable), labels)


def education_valid(variable: str) -> Column:
    (low, high), _ = EDUCATION_VARIABLES[variable]
    return F.col(variable).between(low, high)


def parity(count: Column, null_is_zero: bool = True) -> Column:
    """Previous live births capped at 3; 99 is its own level."""
    capped = F.when(count == V.PARITY_UNKNOWN, "Ign").otherwise(
        code_text(F.when(count > 3, F.lit(3.0)).otherwise(count)))
    return F.when(count.isNull(), "0" if null_is_zero else None).otherwise(capped)


def visits(code: Column) -> Column:
    return label(code, V.VISITS)


def first_trimester(month: Column) -> Column:
    """1 for months 1-3, 0 for 4-9, null for anything else."""
    return F.when(month.between(1, 9), (month <= 3).cast("int"))


def share(flag: Column) -> Column:
    """Percentage of rows where a nullable flag holds, over the rows where it is known."""
    return 100 * F.avg(flag.cast("int"))


def r6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)
