"""glintframe: forensic-scoring analytics as lazy Spark DataFrame operators."""
