"""gleanery: catalog building and source-quality operators for PySpark.

Every operator is a plain function from DataFrames and parameters to a DataFrame.
"""
