"""Composed plans (fixture -> clean -> entities -> features -> ...) and the
query catalog used by ``__spark_entry__``."""
