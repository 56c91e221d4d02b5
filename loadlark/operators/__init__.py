"""Operators: functions from DataFrames to DataFrames, each keyed by an entity."""
