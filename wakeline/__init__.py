"""Wakeline: track and behaviour analytics on Spark DataFrames."""
