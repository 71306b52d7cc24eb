"""Document ingestion, structure-preserving chunking and hybrid retrieval on PySpark DataFrames."""
