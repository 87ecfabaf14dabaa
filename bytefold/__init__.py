"""bytefold: byte-level subword vocabularies over Spark DataFrames."""
