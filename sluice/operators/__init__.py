"""Operators of the message log: functions from DataFrames to DataFrames."""
