"""Spark session settings used by the tests and the benchmark."""

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **settings) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("vitalcells")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", True)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", False)
        .config("spark.python.sql.dataFrameDebugging.enabled", False)
        .config("spark.ui.showConsoleProgress", False)
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
