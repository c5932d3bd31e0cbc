"""shiftlens: explain why a business metric moved, as Spark DataFrame jobs."""
