"""Track-catalogue analytics as Spark DataFrame operators."""
