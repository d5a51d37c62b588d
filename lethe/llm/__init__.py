"""Operators for a training-data pipeline, one module per operator.

Nothing outside this package imports it; ``queries`` lists the registered
queries and their SQL.
"""
