"""docmine: document and chemical-structure mining as plain Spark DataFrame jobs."""
