"""kappaloom: annotation, agreement and audit analytics as Spark DataFrame plans."""
