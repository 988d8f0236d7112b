"""Operators over DataFrames: retrieval, evaluation, data sets, reports."""
