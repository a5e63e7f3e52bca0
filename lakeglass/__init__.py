"""Lakeglass: a Spark-native analytics engine for object stores and their contents."""
