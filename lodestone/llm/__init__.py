"""Training-data operators.

Thirteen operators a training-data pipeline needs, each a function from DataFrames to
DataFrames. Nothing else in the library imports this subpackage.
"""
