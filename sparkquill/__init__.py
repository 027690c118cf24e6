"""Citation and quotation checks, and training-data operators, as Spark DataFrame jobs."""
