"""Operators for preparing training data: one module for each operator, each
holding its Spark operator, its registered query and, where SQL can say it,
the SQL twin.  Nothing outside this package imports it."""
