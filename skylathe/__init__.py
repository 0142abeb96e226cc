"""Spark-native operators for irregular time series, photometry-style tables and image stamps."""
