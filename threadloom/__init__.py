"""Customer-support conversation analytics on PySpark."""
