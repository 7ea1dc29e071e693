"""Plumbline: measurement analytics on Spark DataFrames."""
