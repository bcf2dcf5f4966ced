"""Relevance of texts to a list of phrases: hits, tier, ordered report, dated snapshots."""

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V


def whole_words(phrase: str) -> str:
    """Pattern of a phrase with no letter before or after it."""
    return rf"(^|[^\p{{L}}]){re.escape(phrase.lower())}($|[^\p{{L}}])"


def pieces(text: str) -> list[str]:
    """Runs of letters and of other characters, in turn."""
    return ["".join(run) for _, run in groupby(text, str.isalpha)]


def with_hits(rows: DataFrame, text: str, phrases: tuple[str, ...] | list[str]) -> DataFrame:
    """Add the phrases each text contains as whole words, ignoring case, and their number.

    A text is cut into runs of letters and runs of other characters once. Where a run is some phrase's
    first word, the runs from there on, as many as a phrase has, are looked up among the phrases; both
    lookups are by hash, so the work does not grow with the number of phrases. The whole text is searched.
    """
    shown = {p.lower(): p for p in phrases}
    cut = {low: pieces(low) for low in shown}
    for low, parts in cut.items():
        if not (parts and parts[0].isalpha() and parts[-1].isalpha()):
            raise ValueError(f"{low!r} must begin and end with a letter")
    firsts = sorted({parts[0] for parts in cut.values()})
    lengths = F.array(*[F.lit(n) for n in sorted({len(parts) for parts in cut.values()})])
    runs = F.col("_runs")

    def starting(run, at):
        ahead = F.transform(lengths, lambda n: F.array_join(F.slice(runs, at + 1, n), ""))
        return F.when(run.isin(firsts), ahead).otherwise(F.array().cast("array<string>"))

    found = F.filter(F.flatten(F.transform(runs, starting)), lambda p: p.isin(list(shown)))
    in_order = F.array_intersect(F.array(*[F.lit(p) for p in shown]), F.coalesce(found, F.array().cast("array<string>")))
    names = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return (rows.withColumn("_runs", F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)))
            .withColumn("achados", F.transform(in_order, lambda p: F.element_at(names, p)))
            .withColumn("n_achados", F.size("achados")).drop("_runs"))


def tier(hits: Column, central: int, eligible: Column, deadline_open: Column) -> Column:
    """High: central theme, clearly eligible, feasible deadline. Medium: partly. Low: the rest.

    An unknown eligibility or deadline counts as not met.
    """
    eligible, deadline_open = F.coalesce(eligible, F.lit(False)), F.coalesce(deadline_open, F.lit(False))
    return (F.when((hits >= central) & eligible & deadline_open, V.TIERS[0])
            .when((hits >= 1) & (eligible | deadline_open), V.TIERS[1])
            .otherwise(V.TIERS[2]))


def tier_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in V.TIERS]), name)


def report(rows: DataFrame, order: list) -> DataFrame:
    """High to low with the report's fields in front."""
    return rows.orderBy(tier_rank(F.col("aderencia")), *order)


def write_snapshot(rows: DataFrame, folder: str, date: str) -> str:
    """One folder per date; an existing one is never replaced."""
    path = f"{folder}/data={date}"
    rows.write.mode("errorifexists").parquet(path)
    return path
