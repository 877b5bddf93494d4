"""Trade-catalogue analytics as composable PySpark DataFrame operators."""
