"""Reading, writing and the run-history table."""
