"""Document-span analytics and corpus preparation on Spark."""
