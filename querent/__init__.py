"""Spark-native retrieval, grounding and corpus analytics."""
