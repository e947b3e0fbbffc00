"""Map-feature analytics as Spark DataFrame operators."""
