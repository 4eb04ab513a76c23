"""Change data to analytical tables, on Spark."""
