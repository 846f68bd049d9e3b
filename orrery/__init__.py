"""Spark-native retrieval, evaluation, usage analytics and corpus preparation."""
