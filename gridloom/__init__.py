"""Panel analytics on Spark: formula batches over (date, asset, step) panels, planned as DataFrames."""
