"""Measurement and verification of energy savings on Spark DataFrames."""
