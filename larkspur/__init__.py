"""Schema analytics on Spark: catalogs, types, diffs and DDL plans as DataFrames."""
