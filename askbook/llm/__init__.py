"""Operators of a training-data pipeline: ten of them, each DataFrame in, DataFrame out."""
