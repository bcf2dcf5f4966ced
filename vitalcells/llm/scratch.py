"""Intermediate tables in the folder that all executors share."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vitalcells.storage import shared_folder

#: Shuffle files of a finished write are of no more use; rows handed to Python come in bounded batches.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
            "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str] = SETTINGS):
    """Session settings for the time of a write."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Scratch:
    """A folder of one operator run; tables written here cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
        self._round = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        self._round += 1
        path = f"{self.root}/{self._round:03d}-{name}"
        schema: StructType = df.schema
        with settings(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(schema).parquet(path)
        table._scratch_path = path  # noqa: SLF001  remembered for drop()
        return table

    def drop(self, table: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
