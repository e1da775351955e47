"""Survey, indicator and document-collection analytics expressed as Spark DataFrame jobs."""
