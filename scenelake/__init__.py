"""Scene and point-cloud analytics as PySpark DataFrame operators."""
