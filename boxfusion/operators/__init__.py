"""Operators: functions of DataFrames and parameters."""
