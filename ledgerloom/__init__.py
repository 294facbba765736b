"""Cloud-spend analytics as lazy Spark DataFrame operators."""
