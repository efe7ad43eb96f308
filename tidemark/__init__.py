"""Review-intelligence analytics as lazily planned Spark DataFrame transformations."""
