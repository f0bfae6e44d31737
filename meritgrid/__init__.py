"""Expert-ranking analytics expressed as Spark DataFrame, SQL and streaming plans."""
