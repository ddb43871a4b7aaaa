"""Gleaner: reading-triage operators for Apache Spark.

Every operator is a function over Columns or DataFrames.  Nothing here holds
session state, and nothing collects table rows to the driver.
"""
