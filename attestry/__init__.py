"""attestry: evidence-backed records on Spark.

Every operator is a plain function from DataFrames (and fixed rule values) to a DataFrame.
"""

__version__ = "0.1.0"
