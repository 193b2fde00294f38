"""dnslens: DNS traffic analytics as Spark DataFrame operators."""
