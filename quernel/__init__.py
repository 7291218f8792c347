"""Spark-first tabular analytics: every operator is a lazy DataFrame plan."""
