"""Relational missing-value imputation expressed as Spark DataFrame plans."""
