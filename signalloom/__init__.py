"""Signal fusion and large-corpus operators as Spark DataFrame jobs."""
