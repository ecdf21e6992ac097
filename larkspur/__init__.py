"""A PySpark-native engine for retrieval, evaluation analytics and training-data preparation."""
