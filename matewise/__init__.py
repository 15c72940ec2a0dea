"""matewise: read-pair assembly and evidence analytics on Spark DataFrames."""
