"""tracewell: a PySpark-native engine for measurement traces aligned to symbolic sequences."""
