"""Report files: CSV with provenance, CSV with comment lines, text logs, Markdown tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcells.storage import is_written


def write_csv(df: DataFrame, path: str, provenance: str) -> None:
    """Write parts in parallel, and the provenance line beside them where readers skip it."""
    df.write.mode("overwrite").option("header", True).csv(path)
    line = df.sparkSession.createDataFrame([(f"# {provenance}",)], "value string")
    line.write.mode("overwrite").text(f"{path}/_provenance")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a CSV with a header, skipping lines that start with '#'."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/_provenance").select(F.col("value").alias("provenance"))


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame:
    """A report that may not exist yet: its rows, or none."""
    if is_written(spark, path):
        return read_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def newest(lines: DataFrame) -> DataFrame:
    """Keep the lines of the last file by name. `lines` has columns (file, value)."""
    last = lines.agg(F.max("file").alias("file"))
    return lines.join(last, "file", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), "value")


def cascade_from_log(lines: DataFrame) -> DataFrame:
    """Step names and counts from log lines such as 'cascata 1_step: 1,234'."""
    pattern = r"cascata (\d_[^:]+): ([\d,]+)"
    return lines.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).alias("passo"),
        F.regexp_replace(F.regexp_extract("value", pattern, 2), ",", "").cast("bigint").alias("n"))


def markdown_row(*cells) -> Column:
    """One Markdown table row as text."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_cells(lines: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a Markdown table as columns; other lines are dropped."""
    cells = F.split(F.regexp_replace("value", r"^\s*\|\s*|\s*\|\s*$", ""), r"\s*\|\s*")
    return (lines.where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[-:| ]+$"))
            .select(cells.alias("cells")).where(F.size("cells") == len(names))
            .select(*[F.col("cells")[i].alias(name) for i, name in enumerate(names)])
            .where(F.col(names[0]) != names[0]))
