"""Bulk analysis of cardiopulmonary exercise tests on Spark DataFrames."""
