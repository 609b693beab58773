"""Arrays, tensors, measurement statistics, spectra, linear algebra and fits over Spark DataFrames.

Two forms of the same data: packed (an array column, one row a tensor) in `functions`, and long (one row a cell, with
index columns) in `operators`. `plans` chooses between them and converts.
"""
