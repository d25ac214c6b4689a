"""Data preparation on Spark DataFrames: operators, dataset jobs, splits and checks."""
