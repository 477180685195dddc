"""Document ingest, indexing, retrieval and evaluation as Spark DataFrame plans."""
