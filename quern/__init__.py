"""quern: tabular analytics, data quality and honest model evaluation on Spark DataFrames."""
