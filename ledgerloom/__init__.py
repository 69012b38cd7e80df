"""Ledger linkage analytics and corpus preparation on Spark DataFrames."""
