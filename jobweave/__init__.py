"""Spark-native job-catalogue, profile-matching and application analytics."""

__version__ = "0.1.0"
