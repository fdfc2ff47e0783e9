"""Search and analysis of document collections on Spark."""
