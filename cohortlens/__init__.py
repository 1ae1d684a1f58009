"""Spark-first engine for leakage-safe cohorts, exact retrieval and clustered evaluation statistics."""
