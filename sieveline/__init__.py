"""A Spark-first engine for evidence retrieval, evidence statistics and text collections."""
