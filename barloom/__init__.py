"""Spark-native analytics and verification of bar series and trade ledgers."""
