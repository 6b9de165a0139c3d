"""Network-capture analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; packets are rows, a
capture is the set of rows sharing ``filename``.
"""
