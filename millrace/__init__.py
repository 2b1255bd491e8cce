"""millrace: semantic assessment analytics as Spark DataFrame plans."""
