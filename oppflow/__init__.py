"""oppflow: record linkage, rules, ranking and incremental merge on Spark DataFrames."""
