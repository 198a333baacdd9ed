"""Readers that turn files, logs and databases into DataFrames."""
