"""Prediction-market event analytics as Spark DataFrame operators."""

from tidewatch.session import configure, settle

__all__ = ["configure", "settle"]
