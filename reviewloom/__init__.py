"""reviewloom: review analytics as PySpark DataFrame operators."""
