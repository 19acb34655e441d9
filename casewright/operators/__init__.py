"""Operators: functions from evidence DataFrames to DataFrames."""
