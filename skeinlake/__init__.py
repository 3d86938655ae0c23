"""Skeinlake: analytics over large archives of conversations, as Spark DataFrames."""
