"""Operators: functions of DataFrames to DataFrames; none runs an action."""
