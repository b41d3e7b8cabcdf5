"""Operators: functions from DataFrames to DataFrames, none of which runs a job of its own
unless its docstring says so."""
