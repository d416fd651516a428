"""Tabular price modelling on Spark: cleaning, splits, preparation, selection, models, run analytics."""

__version__ = "0.1.0"
