"""Registry analytics on Spark: dirty yearly records to cohorts, tables and cell-based models."""
