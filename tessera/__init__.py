"""tessera: a Spark-first engine for indexing, ranking and searching collections of text and source files."""
