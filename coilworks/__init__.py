"""Spark-native processing of chemical-shift depositions and of training data."""
