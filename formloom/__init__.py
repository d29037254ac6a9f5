"""A Spark-first engine that turns unstructured documents into validated tables."""
