"""Code-health analytics over source and text corpora, expressed as Spark DataFrames."""
