"""Batch operators: pure functions DataFrame -> DataFrame with an explicit ``now_ms``."""
