"""Forecast analytics on Spark DataFrames: price histories, point-in-time features, scoring, selection, decisions."""
