"""Spark-native analytics: relational helpers, event-time operators, versioned tables and data kernels."""
