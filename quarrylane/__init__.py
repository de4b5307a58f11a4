"""Document-intelligence and job-analytics operators for Spark."""
