"""Operators of a training-data pipeline: scoring, dedup, decontamination, tokenizing, formatting.

Nothing outside this folder imports it.  Every operator takes DataFrames and column names, reads only
the columns it names and returns a fixed schema, so extra columns of any name are harmless.
"""
