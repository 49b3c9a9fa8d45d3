"""Payment-risk analytics as Spark DataFrame operators."""
