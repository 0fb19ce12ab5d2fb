"""Trace operators: each takes DataFrames of spans or of model rows and returns DataFrames."""
