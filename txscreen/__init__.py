"""Screening of payment transactions on Spark.

Operators take a DataFrame plus column names and return a lazy DataFrame;
nothing here collects rows unless its name says it fits a model or writes a
table.
"""
