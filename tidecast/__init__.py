"""Leakage-safe panel building, quantile forecasting and forecast scoring on Spark DataFrames."""
