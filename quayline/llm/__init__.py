"""Operators of a training-data pipeline over whole text corpora.

Nothing else in the library imports this package.  Every operator takes DataFrames
and gives DataFrames; per-document work runs inside tasks on Arrow batches, and all
that crosses documents goes through Spark's shuffles.
"""
