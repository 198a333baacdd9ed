"""Lodestone: data profiling and analytics as Spark DataFrame transformations."""
