"""Spark-native analytics for multi-turn agent rollouts."""
