"""Operators for preparing training text: one module per operator, built on Spark DataFrames.

Nothing else in the package imports this subpackage.
"""
