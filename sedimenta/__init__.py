"""A Spark-native engine for filings, facts, documents and training data."""
