"""Operators of a training-data pipeline over document tables, and their registered queries."""
