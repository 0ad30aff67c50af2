"""Operators over words, elements, pages and tables: functions from DataFrames to DataFrames."""
