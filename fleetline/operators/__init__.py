"""Operators: functions of DataFrames that cover all routes and dates at once."""
