"""lexmill: document curation, retrieval and evaluation as Spark DataFrame plans."""
