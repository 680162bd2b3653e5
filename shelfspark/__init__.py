"""shelfspark: product-catalogue analytics as Spark DataFrame plans.

Every operator takes and returns DataFrames (or Columns); the heavy work
runs as Spark jobs (scans, partial aggregates, shuffles, windows). Nothing
is collected to the driver except bounded metadata (pivot domains, fitted
model parameters).
"""

__version__ = "0.1.0"
