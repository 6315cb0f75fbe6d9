"""Spark-native record linkage and relational analytics."""
