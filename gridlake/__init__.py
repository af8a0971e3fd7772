"""Spreadsheet-model analytics as Spark DataFrames."""
