"""Relational and analytic operators on DataFrames."""
