"""Spark-first engine for releasing, attacking and scoring anonymised microdata."""
