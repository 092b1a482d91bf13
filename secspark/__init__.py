"""Analytics for security operations data on Spark."""
