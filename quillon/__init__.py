"""quillon: document, operations and training-data analytics as composable Spark DataFrame transforms."""
