"""Spark-native analytics over support tickets; see README.md."""
