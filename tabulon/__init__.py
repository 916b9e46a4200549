"""Business-analytics toolkit on Spark DataFrames.

Sub-packages: ``sources`` (readers, workspaces, sinks), ``functions`` (column
expressions), ``operators`` (profiling, cleaning, charts, windows, statistics,
models, forecasts), ``streaming`` (scoring of streams), ``plans`` (the
registered queries with the SQL that checks them).
"""
