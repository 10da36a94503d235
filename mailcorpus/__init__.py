"""Spark-native analysis of large e-mail corpora."""
