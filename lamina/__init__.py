"""Content-defined deduplication and snapshot lineage of byte data on Spark DataFrames."""
