"""Document analytics on Spark: documents, pages, blocks and tokens as DataFrames."""
