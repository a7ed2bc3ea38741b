"""folioforge: a Spark-native engine for whole-document text processing."""
