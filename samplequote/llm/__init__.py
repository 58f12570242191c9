"""Operators of a training-data pipeline on Spark, one module per operator."""
