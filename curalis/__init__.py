"""Evidence analytics for Spark: every operator is a function from DataFrames to a DataFrame."""
