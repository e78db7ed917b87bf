"""Fleet maintenance and working-hour analytics as Spark DataFrame operations."""
