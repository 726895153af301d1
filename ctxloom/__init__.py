"""Context retrieval and feedback analytics as Spark DataFrame operators."""
