"""Scalar functions: expressions that the table layer needs, and SQL names that Spark spells otherwise."""
