"""Document query engine on PySpark."""
