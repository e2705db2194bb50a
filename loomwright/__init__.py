"""Spark-native preparation of training data about source code."""
