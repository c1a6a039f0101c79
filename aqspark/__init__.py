"""Air-quality analytics on Spark DataFrames.

Every operator takes DataFrames and parameters and returns a DataFrame, so it
composes with ``df.transform`` and stays lazy until the caller writes or reads
the result.
"""
