"""Library analytics as Spark DataFrame operators."""
