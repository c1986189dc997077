"""Spark-native engine that links free text to coded terminology."""
