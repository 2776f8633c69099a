"""Prepare, score and evaluate multi-class classifiers over tables with ragged columns, on Spark."""

__version__ = "0.1.0"
