"""plumbline: a Spark-native engine for data-removal analytics."""
