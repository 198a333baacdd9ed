"""The catalogue: named queries over the tables, and their SQL."""
