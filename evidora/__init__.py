"""Evidence admission and analytics on Spark."""
